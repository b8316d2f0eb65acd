"""op9_sentence_spans against brute force, and the sentence stage of corpus_pipeline.py on planted passages."""

import random
import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from pitchlake.llm.sentence_spans import LEAST_WORDS, remove_repeated_passages  # noqa: E402


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(8, 10))) for _ in range(n)]


def stage(spark, rows):
    docs = spark.createDataFrame(
        [(i, t, "en", "x", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"
    ).repartition(3)
    return {r.doc_id: r.text for r in corpus_pipeline.repeated_sentences(spark, docs, "").collect()}


def test_planted_passages(spark):
    """51 words, without an end mark, with one or with many, put into texts at random places."""
    rng = random.Random(8)
    rows, planted = [], {}
    for i in range(60):
        passage = words(rng, 51)
        for j in {0: [], 1: [rng.randrange(51)], 2: range(0, 51, 9)}[i % 3]:
            passage[j] += "."
        for j in range(2):
            own = words(rng, rng.randint(40, 120))
            at = rng.randrange(len(own) + 1)
            rows.append((2 * i + j, " ".join([*own[:at], *passage, *own[at:]])))
        planted[2 * i + 1] = passage, own
    got, texts = stage(spark, rows), dict(rows)
    for i, (passage, own) in planted.items():
        left = set(got[i].split())
        assert got[i - 1] == texts[i - 1]
        assert sum(w not in left for w in passage) >= 34 and all(w in left for w in own), i


def test_glued_edges(spark):
    """A repeat of 51 words in clauses of usual length that begins and ends inside others' sentences, without a blank."""
    rng = random.Random(4)
    clause = lambda: " ".join(words(rng, rng.randint(3, 9))) + rng.choice([",", ".", ";", "!\n"])
    rows, planted = [], []
    for i in range(40):
        passage = " ".join(clause() for _ in range(20)).split()[:51]
        own = [[" ".join(clause() for _ in range(8)) for _ in range(2)] for _ in range(2)]
        rows += [(2 * i + j, f"{a}go{' '.join(passage)}ing {b}") for j, (a, b) in enumerate(own)]
        planted.append(passage)
    got = {r.doc_id: (r.text, r.n_removed) for r in remove_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, passage in enumerate(planted):
        assert got[2 * i] == (rows[2 * i][1], 0)
        assert got[2 * i + 1][1] >= LEAST_WORDS and sum(w in got[2 * i + 1][0].split() for w in passage) <= 21, i


def test_short_sentences(spark):
    """Runs of short sentences grow until they have the least number of words; fewer words stay."""
    a = "".join(f"Word{i} two. Three{i}! Four five{i}, six.\n" for i in range(8))
    b = "DER!! BEÜ!! DAS!! Und mehr als vierzig Zeichen! So ist das. "
    rows = [(1, a + "Own end."), (2, "Begin here. " + a), (3, b + "Eins."), (4, b + "Zwei.")]
    assert stage(spark, rows) == {1: a + "Own end.", 2: "Begin here. ", 3: b + "Eins.", 4: b + "Zwei."}


def spans_of(text):
    """(units, [(first unit, end, words)]) by the rule's own words."""
    text = text or ""
    lead = re.match(r"[ \t\r\n]*", text)[0]
    units = re.findall(r"[^.!?,;:\n]*(?:[.!?,;:]+|\n)[ \t\r\n]*|[^.!?,;:\n]+", text[len(lead) :])
    tokens = [re.findall(r"[^ \t\r\n]+", u.lower()) for u in units]
    if units:
        units[0] = lead + units[0]
    out = []
    for i in range(len(units)):
        for j in range(i + (2 if len(units) > 1 else 1), len(units) + 1):
            run = [w for t in tokens[i:j] for w in t]
            if len(run) >= LEAST_WORDS:
                out.append((i, j, " ".join(run)))
                break
    return units, tokens, out


def test_spans_against_brute_force(spark):
    """Random texts with white space and marks in all places, repeated rows, null ids, ties, and columns with clashing names."""
    rng = random.Random(2)
    pool = [
        " ".join(words(rng, rng.choice([1, 2, 9, 40]))) + rng.choice([".", "!?", "...", "\n", ". \n", ".x. ", ",", ";;", " ,\n. ", "\n\n"]) for _ in range(30)
    ]
    rows = [
        (
            i,
            rng.choice(["", " ", "\n\t "]) + "".join(
                p + rng.choice(["", " ", "\t"]) for p in (pool[(k + j) % 30] for k in [rng.randrange(30)] for j in range(rng.randint(1, 8)))
            )
        ) for i in range(150)
    ]
    long = " ".join(words(rng, 300))
    rows += [
        (None, "É x. " * 30), (500, None), (501, ""), (502, " \n"), (503, "..."), (504, long), (505, long), (506, rows[0][1]), (506, rows[0][1]),
        (506, rows[1][1]), (507, "one, " * 3_000)
    ]
    first, seen = {}, {}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    hashes = {
        r.text: r.h for r in spark.createDataFrame([(t,) for t in {t for _, t in rows}], "text string").selectExpr("text", "xxhash64(text) as h").collect()
    }
    for i, t in sorted(set(order), key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]])):
        for a, _, x in spans_of(t)[2]:
            first.setdefault(x, (i, t, a))
    for x in (x for i, t in rows for _, _, x in spans_of(t)[2]):
        seen[x] = seen.get(x, 0) + 1
    expected = []
    for i, t in rows:
        units, tokens, runs = spans_of(t)
        gone = {q for a, b, x in runs if first[x] != (i, t, a) for q in range(a, b)}
        expected.append((i, "".join(u for q, u in enumerate(units) if q not in gone) if gone else t, sum(map(len, tokens)), sum(len(tokens[q]) for q in gone)))
    docs = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, run long, h long, x int").repartition(3)
    got = [(r.doc_id, r.text, r.n_words, r.n_removed) for r in remove_repeated_passages(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert sum(x[3] for x in expected) > 0
    more = {(r.doc_id, r.n_words): r.n_removed for r in remove_repeated_passages(docs, windows=True).collect()}
    assert all(more[i, n] >= k for i, _, n, k in expected)
