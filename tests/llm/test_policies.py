"""op4's placement against a plain loop, op10's columns against their definition, op2's sparse fit against dense matrices."""

import hashlib
import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from pitchlake.llm import license_scan, webp  # noqa: E402
from pitchlake.llm.packing import Windows, pack  # noqa: E402


def plain_place(lengths, size, places):
    """(window, offset) of each piece, and which windows were emitted before the end, in order."""
    open_, out, closed, made = [], [], [], 0
    for n in lengths:
        fits = [w for w in open_ if size - w["used"] >= n]
        if fits:
            w = min(fits, key=lambda w: (size - w["used"], w["number"]))
        else:
            if len(open_) == places:
                fullest = min(open_, key=lambda w: (size - w["used"], w["number"]))
                open_.remove(fullest)
                closed.append(fullest["number"])
            w = {"number": made, "used": 0}
            made += 1
            open_.append(w)
        out.append((w["number"], w["used"]))
        w["used"] += n
        if w["used"] == size:
            open_.remove(w)
    return out, closed


@pytest.mark.parametrize("places", [1, 3, 64])
def test_windows_are_placed_by_best_fit_and_the_fullest_goes(places):
    rng = random.Random(places)
    lengths = [rng.choice([1, 2, 5, 30, 31, 32, 60, 63]) if rng.random() < 0.5 else rng.randint(1, 63) for _ in range(2000)]
    windows, got, closed = Windows(64, places), [], []
    for i, n in enumerate(lengths):
        window, offset, gone = windows.put(i, n)
        got.append((window, offset))
        closed += [] if gone is None else [gone]
        assert len(windows.rooms) <= places
    assert (got, closed) == plain_place(lengths, 64, places)


def test_packed_sequences_are_gapless_and_nearly_full(spark):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(rng.choice([0, 3, 40, 200, 700]))) for _ in range(400)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, sequence_id string, offset int").repartition(3)
    rows = pack(docs, public_tokenizers.path("byte_bpe_50k.json"), size=512, places=8).collect()
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0) and r.offset + r.length <= 512
        used[r.sequence_id] = r.offset + r.length
    tokens = sum(used.values())
    # at most one sequence is half empty once leftovers are merged, beside those emitted as the fullest
    assert len(used) <= 1.1 * (tokens / 512) + 1


def test_every_column_of_the_stored_form(spark):
    rng = random.Random(3)
    texts = [None, "", "a" * 63, "a" * 64, "a" * 65, "é" * 500, "abcd" * 900, "".join(rng.choices("xyz \n", k=5000)), bytes(rng.choices(range(32, 127), k=4000)).decode()]
    texts += [texts[5], texts[7], None, ""]
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(texts)], "doc_id long, text string, feature string, media_bytes int").repartition(3)
    stored = webp.store_texts(docs)
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    got = {r.doc_id: r for r in webp.read_payloads(stored).collect()}
    assert sorted(got) == list(range(len(texts)))
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        upper, r = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16), got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert (r.media_bytes, r.media_sha256) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        assert r.feature == f"{','.join(map(str, upper))}|{np.mean(np.frombuffer(payload, np.uint8)):.4f}"
    for i, j in ((5, 9), (7, 10), (0, 1), (0, 11), (1, 12)):
        assert media[i] == media[j] and tuple(got[i])[1:] == tuple(got[j])[1:]


def test_a_text_of_several_files_is_read_back(spark):
    rng = np.random.default_rng(4)
    text = rng.integers(97, 123, webp.MOST_BYTES + 1000, dtype=np.uint8).tobytes().decode()
    stored = webp.store_texts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert bytes(stored.first().media).count(b"WEBPVP8L") == 2
    r = webp.read_payloads(stored).first()
    payload = text.encode().ljust(-(-len(text) // 64) * 64, b"\0")
    assert (r.payload_bytes, r.payload_sha256) == (len(payload), hashlib.sha256(payload).hexdigest())


def test_sparse_products():
    model = license_scan.fit([], variants=3, steps=1)
    texts = ["Licensed under CC BY 4.0.", "", "nothing of that", "Licensed under the Apache License, Version 2.0. Licensed under CC BY 4.0."]
    x = license_scan.Sparse(model, texts)
    dense = np.zeros(x.shape)
    dense[x.row, x.column] = 1
    rng = np.random.default_rng(0)
    w, g = rng.random((x.shape[1], 3)), rng.random((x.shape[0], 3))
    assert np.allclose(x.times(w), dense @ w) and np.allclose(x.transposed_times(g), dense.T @ g)
    keep = np.array([True, False, False, True])
    assert np.allclose(x.rows(keep).times(w), dense[keep] @ w) and dense.sum() > 0


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "line\n" * 3 + "x" * 200 + "\n\nwrapped\nlines"), (2, "\n".join(f"other {i}" for i in range(50))), (3, None)], "doc_id long, text string")
    assert len(license_scan.sample_paragraphs(docs, "text", 48, most=7)) == 7
    every = license_scan.sample_paragraphs(docs, "text", 48, most_bytes=100)
    assert "x" * 200 not in every and "wrapped lines" in every and every.count("line") == 3
