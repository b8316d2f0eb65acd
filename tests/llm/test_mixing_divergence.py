"""op12 and op13 against plain loops."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from math import floor

import numpy as np
import pytest

from pitchlake.llm import mixing
from pitchlake.llm.divergence import audit, distinct, slices
from pitchlake.llm.mixing import mix

SCHEMA = "doc_id long, text string, lang string, source string, target string, rank string, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA).repartition(3)


def documents(seed, n=160):
    rng = random.Random(seed)
    names = ["a", "ab", "Z", "é", "", None, "hot"]
    out = []
    for i in range(n):
        source = "hot" if rng.random() < 0.4 else rng.choice(names)
        words = " ".join(rng.choice(["the", "The", "Straße", "x1y", "née", "日本", "ﬁn", "b_c", "q"]) for _ in range(rng.choice([0, 1, 3, 9, 60])))
        out.append((None if i % 37 == 0 else i, rng.choice([words, words, words, None, " \t", "same words here\x0b\x1f"]), rng.choice(["en", "de", None]), source))
    return out + out[:3] + [(n, "long " * 5000, "en", "ab")]


# ---- mixing

def test_targets(spark):
    rng = random.Random(2)
    for sizes in ([5, 5, 5], [1, 100, 100, 0], [rng.randrange(10**6) for _ in range(40)], [0, 0], [7]):
        names = [f"s{i:02}" for i in range(len(sizes))]
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()}
        weight = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
        left, above, open_ = float(sum(sizes)), {}, set(range(len(sizes)))
        while True:  # the contract's own words
            share = {i: left * weight[i] / sum(weight[j] for j in open_) for i in open_}
            over = {i for i in open_ if share[i] > 3 * sizes[i]}
            if not over:
                break
            for i in over:
                above[i] = 3 * sizes[i]
                left -= above[i]
            open_ -= over
        want = {names[i]: (above | share)[i] for i in range(len(sizes))}
        assert got == pytest.approx(want)


@pytest.mark.parametrize("group_rows", [4, 1 << 20])
def test_mixing(spark, monkeypatch, group_rows):
    monkeypatch.setattr(mixing, "GROUP_ROWS", group_rows)
    rows = documents(1)
    got = mix(table(spark, rows)).collect()
    assert len(got) == len(rows)
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    by_source = defaultdict(list)
    for i, text, _, source in rows:
        h = hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        by_source[source].append((size(text), h, i))
    want, totals = Counter(), {s: sum(x[0] for x in v) for s, v in by_source.items()}
    target = {r["source"]: r["target"] for r in got}
    assert sum(target.values()) == pytest.approx(sum(totals.values()))
    for s, docs in by_source.items():
        rate = target[s] / totals[s] if totals[s] else 0.0
        offset = int(hashlib.md5(f"0:{s or ''}".encode()).hexdigest()[:4], 16) / 65536
        for place, (n, _, i) in enumerate(sorted(docs, key=lambda x: (x[0], x[1], x[2] or -1)), 1):
            copies = floor(place * rate + offset) - floor((place - 1) * rate + offset)
            assert copies <= 3
            want[i, n, totals[s], n * copies, s, copies] += 1
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - target[s]) <= 2 * max(x[0] for x in docs)
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["taken"], r["source"], r["copies"]) for r in got) == want
    assert sorted(map(str, got)) == sorted(map(str, mix(table(spark, rows).repartition(5)).collect()))


# ---- divergence

def plain_audit(rows, top=200):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    groups, seen, whole = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        found = terms(text)
        groups[lang or "", source or ""].update(found)
        whole[lang or ""].update(found)
        seen[lang or ""].update(set(found))
    out = set()
    for lang, docs in seen.items():
        kept = sorted(t for t, n in docs.items() if n >= 3)
        mine = {s: c for (x, s), c in groups.items() if x == lang}

        def p(counts, kept=kept):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        ps, q = {s: p(c) for s, c in mine.items()}, p(whole[lang])
        f = lambda a, b: (a - b) * (a - b) // b
        for s in mine:
            parts = {
                "pair": [(sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in mine if o != s],
                "term": [(f(ps[s][t], q[t]), t) for t in kept if mine[s][t] > 0 and ps[s][t] > q[t]]
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, t, v, i) for i, (v, t) in enumerate(items, 1) if part == "pair" or i <= top}
    return out


@pytest.mark.parametrize(("block_rows", "tile"), [(1 << 18, 512), (5, 512), (7, 2), (3, 1)])
def test_divergence(spark, block_rows, tile):
    rows = documents(3)
    got = [tuple(r) for r in audit(table(spark, rows), block_rows=block_rows, tile=tile).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows)


def test_divergence_where_no_term_is_kept(spark):
    rows = [(1, "one two", "en", "a"), (2, "three", "en", "b"), (3, None, "en", None), (4, "!", "fr", "a")]
    got = {tuple(r) for r in audit(table(spark, rows)).collect()}
    assert got == plain_audit(rows) and len(got) == 6


def test_divergence_of_a_very_long_text(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{'abcdefgh'[rng.randrange(8)]}" for _ in range(5)), "en", "ab"[i % 2]) for i in range(9)]
    rows.append((10, " ".join("".join(rng.choices("abcdef", k=3)) for _ in range(600_000)), "en", "a"))
    assert {tuple(r) for r in audit(table(spark, rows)).collect()} == plain_audit(rows)


def test_hash_collisions_are_told_apart(monkeypatch):
    monkeypatch.setattr("pitchlake.llm.divergence.xxhash.xxh3_64_intdigest", lambda w: len(w) % 2)
    words = [b"a", b"bb", b"ccc", b"a", b"dd", b"bb", b"ccc"]
    names, back = distinct(words)
    assert [names[i] for i in back] == words and sorted(names) == sorted(set(words))


def test_terms_end_with_their_text():
    texts = ["ab", "", "Cd!", "é", "x y"]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    folded, starts, ends = slices(raw, np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]))
    assert [folded[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["ab", "cd", "é", "x", "y"]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert mix(none).collect() == [] and audit(none).collect() == []
