"""The operators of pitchlake/llm against brute force on small tables with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from pitchlake.llm import webp  # noqa: E402
from pitchlake.llm.decontamination import find_leaks  # noqa: E402
from pitchlake.llm.graph import components  # noqa: E402
from pitchlake.llm.jaccard_join import near_duplicates  # noqa: E402
from pitchlake.llm.language_id import predict, train  # noqa: E402
from pitchlake.llm.license_scan import TEMPLATES, scan  # noqa: E402
from pitchlake.llm.packing import pack  # noqa: E402
from pitchlake.llm.sentence_spans import remove_repeated_passages  # noqa: E402
from pitchlake.llm.sharding import shard_by_bytes  # noqa: E402
from pitchlake.llm.suffix_dedup import SuffixDedup, previous_factors, remove_repeats  # noqa: E402
from pitchlake.llm.token_counts import count_tokens  # noqa: E402

SCHEMA = "doc_id long, text string, h string, id string, key string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 220)) for _ in range(30)]
    shared = words(rng, 90)
    near = base[3].split()
    near[10] = "other"
    long = words(rng, 9000)
    return [
        None, "", " \n\t", "one", "one two three", "ONE two three", *base, base[0], base[0], " ".join(near), f"{base[5]} {shared} {base[6]}",
        f"{base[7]} {shared}", shared + shared, "a" * 1500, "é" * 700 + shared, long, long + " end", "İstanbul ﬁn <|endoftext|> it's"
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize(("first", "hot"), [(False, 8_192), (True, 8_192), (False, 1), (True, 1)])
def test_suffix_dedup(docs, texts, first, hot):
    length, data = 400, [(t or "").encode() for t in texts]
    count, seen = {}, set()
    for b in data:
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] = count.get(b[s : s + length], 0) + 1
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs, keep_first=first, hot=hot).collect()}
    for i, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen if first else count[w] > 1:
                gone[s : s + length] = True
            seen.add(w)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert got[i] == (len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])), i


def test_suffix_dedup_of_a_passage_in_unlike_texts(spark, monkeypatch):
    """No group of what is ordered in one task has more contents than `hot`, whatever surrounds a passage that all texts have."""
    rng, length, most = random.Random(9), 80, 6
    passage = words(rng, 18)
    data = [f"{words(rng, 20)} {passage[i % 3 * 9 :]} {words(rng, 20)}" for i in range(40)]
    data += [data[3], data[4].replace("a", "b", 1)]
    groups, before = [], SuffixDedup._in_suffix_order

    def seen(self, contexts):
        groups.extend(r.n for r in contexts.groupBy("key", "part").agg(F.countDistinct("content").alias("n")).collect())
        return before(self, contexts)

    monkeypatch.setattr(SuffixDedup, "_in_suffix_order", seen)
    rows = [*enumerate(data), (3, data[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in remove_repeats(docs, length, keep_first=False, hot=most).collect()}
    assert 1 < max(groups) <= most
    count = Counter(t[s : s + length] for _, t in rows for s in range(len(t) - length + 1))
    for i, t in enumerate(data):
        gone = {b for s in range(len(t) - length + 1) if count[t[s : s + length]] > 1 for b in range(s, s + length)}
        assert got[i] == (len(t), len(gone), len([b for b in gone if b - 1 not in gone]), "".join(c for b, c in enumerate(t) if b not in gone).encode()), i


def test_previous_factors():
    text = "abracadabra"
    order = sorted(range(len(text)), key=lambda i: text[i:])
    common = lambda i, j: next((k for k in range(len(text)) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or i + k >= len(text)), 0)
    lcp = np.array([0, *(common(a, b) for a, b in zip(order, order[1:], strict=False))])
    lpf, _ = previous_factors(np.array(order), lcp)
    assert {i: int(x) for i, x in zip(order, lpf, strict=True)} == {i: max((common(i, j) for j in range(i)), default=0) for i in order}


def test_jaccard_join(docs, texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs).collect()}
    assert got == {i: (len(s), g) for i, (s, g) in enumerate(zip(sets, group, strict=True))}


def test_jaccard_join_of_a_large_group(spark):
    """More near copies of a text than a part holds, a chain of small changes, and texts apart."""
    rng = random.Random(9)
    head = words(rng, 60).split()
    texts = [" ".join(head)]
    for _ in range(300):
        copy = list(head)
        copy[rng.randrange(60)] = words(rng, 1)
        texts.append(" ".join(copy))
    link = head
    for i in range(10):
        link = [*link[3:], *words(rng, 3).split()]
        texts.append(" ".join(link))
    texts += [words(rng, 50) for _ in range(50)]
    rng.shuffle(texts)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 100 * len(x & sets[j]) >= 75 * len(x | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    rows = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == dict(enumerate(root))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_decontamination(spark, docs):
    rng = random.Random(9)
    item = words(rng, 40).split()
    changed = list(item)
    changed[12] = changed[25] = "zzz"
    rows = [(1, "pre " + " ".join(item)), (2, " ".join(changed).upper()), (3, " ".join(item[:9])), (4, words(rng, 60)), (5, None), (None, " ".join(item))]
    found = find_leaks(
        spark.createDataFrame(rows, "doc_id long, text string"),
        spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "too short")], "item_id long, text string")
    )
    got = {(r.doc_id, r.item_id): (r.n_equal, r.n_window) for r in found.collect()}
    assert got == {(1, 10): (13, 13), (2, 10): (13, 13), (None, 10): (13, 13)}


def overlap(text, item):
    """(n_equal, n_window) over all alignments, without any seed; None if no window is near enough."""
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    words_, item_ = cut(text), cut(item)
    w, best = min(13, len(item_)), None
    for shift in range(-len(item_) + 1, len(words_)):
        equal = [0 <= shift + p < len(words_) and words_[shift + p] == x for p, x in enumerate(item_)]
        for s in range(len(item_) - w + 1):
            n = sum(equal[s : s + w])
            if w and n and w - n <= int(w * 0.2):
                best = max(best or (0, 0), (n, w))
    return best


def test_decontamination_finds_all_allowed_substitutions(spark):
    """Every choice of words that may differ, for items of 1 to 14 words, amid other words and at a text's ends, against
    brute force without masks; repeated rows, ties of windows, two items with one id, clashing columns."""
    from itertools import combinations

    rng = random.Random(3)
    items, docs_ = [], []
    for n in range(1, 15):
        item = [f"i{n}w{k}" for k in range(n)]
        items.append((n, " ".join(item), "x", 1))
        for gone in combinations(range(n), int(min(n, 13) * 0.2) + (n == 9)):
            changed = [f"other{k}" if k in gone else w for k, w in enumerate(item)]
            docs_.append(" ".join(["a", *changed, "b", "c"]))
        docs_ += [" ".join(item[2:]), " ".join(item[1:]) + "!", " ".join(item[:-1]), " ".join([*item, "and", *item])]
    items += [
        (14, "quite another text", "x", 2), (14, items[13][1], "x", 2), (None, "null id of an item here", "x", 3), (20, None, "x", 4),
        (21, " ... ", "x", 5)
    ]
    docs_ += ["there is quite another text in it", "NULL id; of an item, here", "", None, "...", words(rng, 30)]
    rows = [(i, t, 7, 8, 9) for i, t in enumerate(docs_)]
    rows += [rows[40], (None, docs_[40], 1, 1, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, i int, seed int, h int").repartition(3)
    found = find_leaks(df, spark.createDataFrame(items, "item_id long, text string, item string, j int"))
    got = [(r.doc_id, r.item_id, r.n_equal, r.n_window) for r in found.collect()]
    expected = {}
    for i, t, *_ in rows:
        for k, x, *_ in items:
            if best := overlap(t, x):
                expected[i, k] = max(expected.get((i, k), (0, 0)), (best[1], best[0]))
    assert len(got) == len(set(got)) and {(a, b): (w, n) for a, b, n, w in got} == expected


def test_license_scan(spark):
    rng = random.Random(3)
    plain = [(i, "\n".join(words(rng, 20) for _ in range(4)), None) for i in range(40)]
    notices = [(100 + i, f"{words(rng, 8)}\n{t[0]}\n{words(rng, 8)}", f) for i, (f, t) in enumerate(sorted(TEMPLATES.items()))]
    found = scan(
        spark.createDataFrame([(i, t) for i, t, _ in [*plain, *notices, (500, None, None), (501, "", None)]], "doc_id long, text string")
    ).where("confirmed")
    assert {(r.doc_id, r.paragraph, r.family) for r in found.where("lines = 1").collect()} == {(i, 1, f) for i, _, f in notices}


def licence_words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))


def licence_grams(text):
    w = licence_words(text)
    return {tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)}


def test_license_scan_against_brute_force(spark):
    """Sets of n-grams and the softmax by their definitions, for lines and for blocks of wrapped lines; null, empty and
    repeated rows, null ids, clashing columns."""
    from pitchlake.llm import license_scan as L

    rng = random.Random(6)
    plain = [words(rng, 15) for _ in range(60)]
    wrap = lambda t, n: "\n".join(" ".join(w) for w in (t.split()[i : i + n] for i in range(0, len(t.split()), n)))
    texts = [None, "", "\n\n", *("\n".join(rng.sample(plain, 4)) for _ in range(20))]
    for family, templates in sorted(L.TEMPLATES.items()):
        for t in templates:
            texts += [f"{plain[1]}\n{t}\n\n{plain[2]}", f"{plain[3]}\n\n{wrap(t, 4)}\n\n{plain[4]}", f"{t} {t}", f"{plain[5]} {' '.join(t.split()[:2])}"]
    rows = [(i, t, 1, "x", 0.5) for i, t in enumerate(texts)] + [(None, texts[30], 1, "x", 0.5), (24, texts[24], 1, "x", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lines int, family string, probability double").repartition(3)
    model = L.fit(L.sample_paragraphs(df, "text", 48))
    assert model.held["false"] <= 0.02 and model.held["missed"] <= 0.05
    names = {}
    for templates in L.TEMPLATES.values():
        for t in templates:
            for n, h in enumerate(L._gram_list(t), 1):
                w = licence_words(t)
                for i, x in enumerate(h.tolist()):
                    names[int(np.searchsorted(model.vocabulary, np.uint64(x)))] = tuple(w[i : i + n])
    number = {g: i for i, g in names.items()}
    assert len(number) == len(model.vocabulary)

    def judge(text):
        has = sorted(number[g] for g in licence_grams(text) if g in number)
        if not has:
            return None
        z = (model.weights[has].sum(axis=0) + model.bias) / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        if best == len(model.families) - 1:
            return None
        pairs = [{g for g in licence_grams(t) if len(g) == min(2, len(licence_words(t)))} for t in L.TEMPLATES[model.families[best]]]
        return model.families[best], float(p[best]), max(len(x & licence_grams(text)) / len(x) for x in pairs)

    expected = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n") if t else []
        found = {k: judge(x) for k, x in enumerate(lines)}
        expected += [(i, k, 1, *x) for k, x in found.items() if x]
        k = 0
        while k < len(lines):
            n = next((j for j in range(k, len(lines)) if not licence_words(lines[j])), len(lines)) - k
            if n > 1 and (x := judge(" ".join(lines[k : k + n]))) and x[2] >= 0.6 and not any(
                y and y[0] == x[0] and y[2] >= 0.6 for j, y in found.items() if k <= j < k + n
            ):
                expected.append((i, k, n, *x))
            k += max(n, 1)
    got = [(r.doc_id, r.paragraph, r.lines, r.family, r.probability, r.similarity) for r in L.scan(df).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4])
    got, expected = sorted(got, key=key), sorted(expected, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in expected]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in expected])
    assert any(r[2] > 1 for r in got)
    wrapped = {r[0] for r in got if r[5] >= 0.6}
    assert len(wrapped) > 0.9 * 3 * sum(map(len, L.TEMPLATES.values()))


def test_language_id_held_out(spark):
    """op5_language_id on its own held-out rows."""
    from pitchlake.llm.language_id import op5_language_id

    data = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = op5_language_id(spark, "/root/testdata/sf0.01").join(data.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == data.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    judged = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != "und"]
    assert len(judged) > 200 and sum(r.lang == r.lang_pred for r in judged) >= 0.99 * len(judged)


def text_grams(text):
    code = re.sub(r"\W+|[\d_]+", " ", f" {(text or '').lower()} ")
    code = re.sub(" +", " ", code)
    return [code[i : i + n] for n in (3, 4) for i in range(len(code) - n + 1)] if code.strip() else []


@pytest.mark.parametrize("languages", [3, 70])
def test_language_id_against_brute_force(spark, languages):
    """Exact sets of n-grams in place of the filter; more languages than a word has bits; null, letterless and repeated rows, ties."""
    rng = random.Random(languages)
    alphabets = ["".join(rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñç", 12)) for _ in range(languages)]
    speak = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randint(2, 7))) for _ in range(n))
    known = [(f"l{i:02d}", speak(a, 60)) for i, a in enumerate(alphabets) for _ in range(3)] + [("l00", None), (None, "abc"), ("zz", "123 456")]
    texts = [speak(a, rng.randint(1, 40)) for a in alphabets for _ in range(4)] + [
        None, "", "12 34.", "a", "Ä", *["abc defg"] * 2, speak("xyz", 5) + " " + speak(alphabets[1], 5)
    ]
    counts = {}
    for name, t in known:
        if name:
            for g in text_grams(t):
                counts.setdefault(name, {}).setdefault(g, 0)
                counts[name][g] += 1
    rates = {name: {g: n / sum(c.values()) for g, n in c.items()} for name, c in counts.items()}
    sets = {name: {g for g, r in c.items() if r >= 5e-6} for name, c in rates.items()}
    model = train(spark.createDataFrame(known, "lang string, text string"))
    got = predict(
        spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, lang_pred string").repartition(3), model
    ).collect()
    assert len(got) == len(texts)
    for r in got:
        found = text_grams(texts[r.doc_id])
        if not found:
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        share = {name: sum(g in s for g in found) / len(found) for name, s in sets.items()}
        near = 0.01 + 2 / len(found)  # a few n-grams are in the filter by chance
        assert r.lang_pred in share and share[r.lang_pred] >= max(share.values()) - near
        assert abs(r.score - share[r.lang_pred]) < near


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = pack(docs, path, places=4).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_token_counts(docs, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(docs, path, table_size=64).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or "", add_special_tokens=False).ids)
        assert got[i] == (len((t or "").encode()), n, n > 2048), i


def test_token_counts_of_a_repeated_long_word(spark):
    """More tokens than 16 bits hold, in a pre-token that occurs twice in one chunk."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    long = "".join(chr(0x4E00 + i % 20_000) for i in range(30_000))
    n = len(Tokenizer.from_file(path).encode(long, add_special_tokens=False).ids)
    assert n > 65_535
    rows = count_tokens(spark.createDataFrame([(1, long), (2, long), (3, f"a {long} b")], "doc_id long, text string").coalesce(1), path).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {1: n, 2: n, 3: n + 2}


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_texts_that_cancel_out(spark):
    """Strings whose polynomials are equal modulo 2**64 whatever the base is: they must not be taken for each other."""
    from tokenizers import Tokenizer

    a = thue_morse(4096)
    b = a.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, a), (2, b), (3, a[:2048]), (4, b[:2048])], "doc_id long, text string").coalesce(1)
    bpe, word = (Tokenizer.from_file(public_tokenizers.path(f"{n}.json")) for n in ("byte_bpe_50k", "word_bpe_49k"))
    ids = {i: [*bpe.encode(t, add_special_tokens=False).ids, 1] for i, t in ((1, a), (2, b), (3, a[:2048]), (4, b[:2048]))}
    for r in pack(df, public_tokenizers.path("byte_bpe_50k.json")).collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert (r.doc_tokens, r.ids_crc32) == (len(ids[r.doc_id]), zlib.crc32(np.array(own, "<u4").tobytes()))
    counts = {r.doc_id: r.n_tokens for r in count_tokens(df, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert counts == {i: len(word.encode(t, add_special_tokens=False).ids) for i, t in ((1, a), (2, b), (3, a[:2048]), (4, b[:2048]))}
    assert {r.doc_id: r.component_id for r in near_duplicates(df).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    cut = {r.doc_id: r.n_removed for r in remove_repeats(df, length=2048, keep_first=False).collect()}
    starts = {i: {t[k : k + 2048] for k in range(len(t) - 2047)} for i, t in ((1, a), (2, b))}
    assert a[:2048] in starts[1] and (cut[3], cut[4]) == (2048, 2048)


def test_hash_collisions_of_pre_tokens():
    """Every pre-token with one hash: they are still told apart."""
    from pitchlake.llm.pretoken import Pretokens

    class Same(Pretokens):
        def hashes(self, code, starts, ends):
            return np.zeros(len(starts), np.uint64)

    rng = random.Random(5)
    for alphabet in ("ab", "aé中", "a😀b"):
        texts = [" ".join("".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 4, 5, 7, 8, 9, 17]))) for _ in range(60)) for _ in range(5)]
        collide(Same(False, ()), [*texts, "", texts[0]])
    collide(Same(False, ()), ["one two three one", " two one"])
    collide(Same(False, ()), ["", ""])


def collide(pre, texts):
    code, starts, ends, _ = pre.cut(texts)
    at, back = pre.distinct(code, starts, ends)
    name = lambda k: code[starts[k] : ends[k]].tobytes()
    assert [name(at[k]) for k in back] == [name(k) for k in range(len(starts))] and len({name(k) for k in at}) == len(at)


@pytest.mark.parametrize("piece_bytes", [1 << 12, 1 << 30])
def test_sharding(docs, texts, piece_bytes):
    rows = shard_by_bytes(docs, piece_bytes=piece_bytes, tolerance=0.0).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    sizes, slots = [0] * 8, [{} for _ in range(8)]
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard][r.slot] = texts[r.doc_id] or ""
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    # splitters fall as near to their targets as rows allow: every cumulated size is off by the largest row at most
    total, most = sum(sizes), max(len((t or "").encode()) + 1 for t in texts)
    assert all(abs(sum(sizes[: i + 1]) - total * (i + 1) / 8) <= most for i in range(8))
    # equal texts lie side by side
    order = [s[i] for s in slots for i in range(len(s))]
    for t in set(order):
        at = [i for i, x in enumerate(order) if x == t]
        assert at == list(range(at[0], at[0] + len(at)))


def test_sharding_of_copies(spark):
    """One text in a third of all rows, null and repeated ids: shards stay even, copies are split by id."""
    rng = random.Random(1)
    rows = [(i if i % 7 else None, "the same text" if i % 3 == 0 else words(rng, 4), 1) for i in range(3_000)]
    out = shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(4), piece_bytes=1 << 10).collect()
    sizes = [sum(r.size for r in out if r.shard == i) for i in range(8)]
    assert len(out) == 3_000 and max(sizes) < 1.05 * sum(sizes) / 8


def test_webp_round_trip(docs, texts):
    got = {r.doc_id: r for r in webp.read_payloads(webp.store_texts(docs)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        data += b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        assert (got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))


def test_empty_tables(empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    for out in (
        remove_repeats(empty), near_duplicates(empty), scan(empty), predict(empty, train(empty.select("text", F.lit("en").alias("lang")))),
        pack(empty, path), count_tokens(empty, public_tokenizers.path("word_bpe_49k.json")), shard_by_bytes(empty), remove_repeated_passages(empty),
        find_leaks(empty, empty.select(F.col("doc_id").alias("item_id"), "text")), webp.read_payloads(webp.store_texts(empty))
    ):
        assert out.count() == 0
