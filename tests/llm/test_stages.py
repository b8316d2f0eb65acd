"""The stages of corpus_pipeline.py on null and repeated ids."""

import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)


def result(docs):
    return sorted(((r.doc_id, r.text, r.source) for r in docs.collect()), key=str)


def test_one_of_each_group(spark):
    rng = random.Random(4)
    a, b, c, d, e = (words(rng, 80) for _ in range(5))
    rows = [
        (None, a, "x"), (1, a, "x"), (2, a + " end", "x"), (3, b, "x"), (3, b, "x"), (3, c, "x"), (4, b, "x"), (None, d, "x"), (5, e, "y"),
        (5, e, "x"), (6, None, "x"), (6, None, "x"), (7, "", "x"), (None, "", "x")
    ]
    got = result(corpus_pipeline.one_of_each_group(spark, table(spark, rows), ""))
    assert got == sorted([(None, a, "x"), (3, b, "x"), (3, c, "x"), (None, d, "x"), (5, e, "x"), (6, None, "x"), (7, "", "x"), (None, "", "x")], key=str)


def test_decontamination(spark, tmp_path):
    rng = random.Random(6)
    item, clean = words(rng, 40), [words(rng, 60) for _ in range(3)]
    spark.createDataFrame([(10, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [
        (None, f"before {item}", "x"), (None, clean[0], "x"), (1, item, "x"), (1, item, "x"), (1, clean[1], "x"), (2, clean[2], "x"), (3, None, "x"),
        (4, "", "x")
    ]
    got = result(corpus_pipeline.decontamination(spark, table(spark, rows), str(tmp_path)))
    assert got == sorted([(None, clean[0], "x"), (1, clean[1], "x"), (2, clean[2], "x"), (3, None, "x"), (4, "", "x")], key=str)


def test_language_id(spark):
    """Null and letterless texts and such in no learned language go; ids and other columns play no part."""
    rng = random.Random(7)
    speak = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n))
    known = [(i, speak("abcdefg", 60) if i % 2 else speak("nopqrst", 60), "aa" if i % 2 else "nn") for i in range(40)]
    odd = [
        (100, None, None), (101, "", "aa"), (102, "12 + 34", None), (103, speak("ωψχφυτσ", 40), None), (None, known[1][1], None),
        (1, known[0][1], "aa"), (1, known[0][1], "aa")
    ]
    df = spark.createDataFrame([(i, t, x, "s", 0) for i, t, x in [*known, *odd]], SCHEMA).repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.language_id(spark, df, "").collect()), key=str)
    assert got == sorted([(i, t) for i, t, _ in [*known, *odd[4:]]], key=str)


def test_all_stages(spark, tmp_path):
    """run() on planted cases: what each stage is to catch goes, clean documents come out whole, token by token."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(11)
    item, passage = words(rng, 40), words(rng, 60)
    clean = {i: words(rng, 90) for i in range(30)}
    near = clean[3].split()
    near[20] = "changed"
    rows = [(i, t, "aa", "x", len(t)) for i, t in clean.items()]
    rows += [
        (100, clean[5], "aa", "x", 0), (101, " ".join(near), "aa", "x", 0), (102, f"{words(rng, 50)} {item} {words(rng, 30)}", "aa", "x", 0),
        (103, "11 22 33", "aa", "x", 0), (104, None, None, "x", 0)
    ]
    one, two = words(rng, 70), words(rng, 70)
    rows += [(200, f"{one} {passage}", "aa", "x", 0), (201, f"{two} {passage}", "aa", "x", 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {*clean, 200, 201}
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {}
    for r in out:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids) + 1
    for i, t in [*clean.items(), (200, f"{one} {passage}")]:
        assert tokens[i] == count(t), i
    assert count(two) <= tokens[201] < count(f"{two} {passage}") - count(passage) // 2


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, []), str(tmp_path)).count() == 0, name
    kept = table(spark, [(1, "some text of a few words", "x"), (2, None, "x")])
    assert corpus_pipeline.decontamination(spark, kept, str(tmp_path)).count() == 2
