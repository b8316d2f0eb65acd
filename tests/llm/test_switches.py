"""Both sides of every switch by size, on the same rows: the plans differ, the rows don't."""

import random

import pytest

from pitchlake.llm import decontamination, jaccard_join, sentence_spans, suffix_dedup
from pitchlake.llm.decontamination import find_leaks
from pitchlake.llm.jaccard_join import near_duplicates
from pitchlake.llm.sentence_spans import remove_repeated_passages
from pitchlake.llm.suffix_dedup import remove_repeats


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """A third of the texts hold one passage; some are copies or near copies of each other, in several groups."""
    rng = random.Random(11)
    common = words(rng, 12)
    out = []
    for group in range(6):
        head = [*common, *words(rng, 20 + 15 * group)]
        for _ in range(12):
            copy = list(head)
            copy[rng.randrange(12, len(copy))] = words(rng, 1)[0]
            out.append(" ".join(copy))
    for i in range(90):
        out.append(" ".join([*(common if i % 3 == 0 else []), *words(rng, rng.randint(0, 60))]) + ".")
    sentence = " ".join(words(rng, 20)) + ". " + " ".join(words(rng, 16)) + ". "
    out += [" ".join(words(rng, 9)) + ". " + sentence + " ".join(words(rng, 5)) for _ in range(60)]
    rng.shuffle(out)
    return [(i, t) for i, t in enumerate(out)] + [(len(out), None), (len(out) + 1, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).cache()


def both(monkeypatch, module, switches, run):
    usual = sorted(map(str, run().collect()))
    for name, value in switches.items():
        monkeypatch.setattr(module, name, value)
    other = sorted(map(str, run().collect()))
    assert usual == other
    return usual


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = (t or "").lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def test_jaccard_join(monkeypatch, docs, rows):
    got = both(monkeypatch, jaccard_join, {"HOT_FROM": 3, "BIG": 2, "LARGE": 4, "OTHERS": 2, "MOST_IDS": 0, "PART": 3}, lambda: near_duplicates(docs))
    sets, root = sets_of(rows), {i: i for i, _ in rows}
    for i in sets:
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert got == sorted(f"Row(doc_id={i}, n_shingles={len(sets[i])}, component_id={root[i]})" for i, _ in rows)


def test_decontamination(monkeypatch, spark, docs, rows):
    rng = random.Random(5)
    texts = [t for _, t in rows if t and len(t.split()) > 30]
    items = [(f"i{k}", " ".join(texts[k].split()[2 : 2 + n])) for k, n in enumerate((20, 13, 9, 5, 3, 25))] + [("none", " ".join(words(rng, 20)))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    assert both(monkeypatch, decontamination, {"MOST_SEEDS": 0, "MOST_ITEM_BYTES": 0}, lambda: find_leaks(docs, benchmark))


@pytest.mark.parametrize("first", [False, True])
def test_suffix_dedup(monkeypatch, docs, first):
    assert both(monkeypatch, suffix_dedup, {"MOST_BYTES": 0}, lambda: remove_repeats(docs, 80, first))


@pytest.mark.parametrize("windows", [False, True])
def test_sentence_spans(monkeypatch, docs, windows):
    got = both(monkeypatch, sentence_spans, {"HOT_ROWS": 2}, lambda: remove_repeated_passages(docs, windows=windows))
    assert sum("n_removed=0" not in r for r in got) >= 59
