"""Every code point, alone and between letters, digits, blanks and apostrophes: pre-tokens against the libraries."""

import sys

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from pitchlake.llm import packing, token_counts  # noqa: E402
from pitchlake.llm.pretoken import LETTER, ODD, Pretokens  # noqa: E402

#: Letters and digits that Python's tables lack, but the libraries' have.
NEWER = (0x1C8A, 0x105C0, 0xA7CB, 0xA7DA)


def around(c):
    return f"{c} a{c}b {c}1{c} {c}{c}'s{c}'{c}ll  {c}"


@pytest.mark.parametrize(("module", "file"), [(packing, "byte_bpe_50k.json"), (token_counts, "word_bpe_49k.json")])
def test_every_code_point(module, file):
    lib, pre, *_ = module._tools(public_tokenizers.path(file))
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    known = [c for c in points if pre.classes[c] != ODD]
    assert pre.odd([chr(c) for c in points if pre.classes[c] == ODD][::7]).count(False) == 0
    for a in range(0, len(known), 20_000):
        texts = [around(chr(c)) for c in known[a : a + 20_000]]
        texts = [t for t, o in zip(texts, pre.odd(texts), strict=True) if not o]
        _, starts, ends, each = pre.cut(texts)
        joined = "".join(texts)
        words = [joined[s:e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
        # as the operators encode them: the words of one input
        found = lib.encode(words, is_pretokenized=True, add_special_tokens=False)
        own = [[] for _ in words]
        for i, w in zip(found.ids, found.word_ids, strict=True):
            own[w].append(i)
        first = 0
        for text, n, whole in zip(texts, each.tolist(), lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            assert [i for w in own[first : first + n] for i in w] == whole.ids, text
            first += n


def test_newer_characters_through_the_operators(spark):
    texts = [around(chr(c)) for c in NEWER] + ["plain", "", None, *(f"a{chr(c)}b" * 300 for c in NEWER)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts, packs = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    right = [len(e.ids) for e in token_counts._tools(counts)[0].encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, counts).collect()} == dict(enumerate(right))
    ids = [len(e.ids) + 1 for e in packing._tools(packs)[0].encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
    assert {r["doc_id"]: r["doc_tokens"] for r in packing.pack(docs, packs).collect()} == dict(enumerate(ids))


class Watched:
    """A tokenizer that notes what it is given."""

    def __init__(self, lib):
        self.lib, self.given = lib, []

    def __getattr__(self, name):
        def call(x, **how):
            self.given.append(x)
            return getattr(self.lib, name)(x, **how)

        return call


def test_new_words_of_a_blank_and_letters_are_encoded_as_one_text(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    words = [f"{a}{b}{c}" for a in ("queeä", "Ouatwh", "日本", "ñó") for b in ("chst", "ß", "Éll") for c in ("nded", "ïv", "xq")]
    texts = [" ".join(words[:20]) + "  it's 12,5\n", " " + " ".join(words[10:]), "'s", "", "\n \t" + "!?" * 300]
    watched = Watched(lib)
    rest = packing._tools(path)
    monkeypatch.setitem(packing._KEPT, path, (watched, rest[1], packing.Cache(1_000), *rest[3:]))
    ids, offsets = packing.encode_ids(texts, path)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(watched.given) == 2 and [type(x[0]) for x in watched.given] == [str, list]  # not the words' own inputs, but for the odd few
    assert not any(w.startswith(" ") and w[1:].isalpha() for w in watched.given[1][0])


def test_ids_that_are_not_their_bytes_are_encoded_word_by_word():
    lib, words = Tokenizer.from_file(path := public_tokenizers.path("byte_bpe_50k.json")), [" one", " twoish", " threeñ"]
    expected = [np.array(lib.encode(w).ids, np.uint32).tobytes() for w in words]
    widths = packing._tools(path)[3]
    for x in (widths, np.zeros_like(widths)):
        assert packing._encode_words(lib, x, words, True) == packing._encode_words(lib, x, words, False) == expected


def test_places_of_distinct_pretokens():
    pre = Pretokens(False, ())
    code, starts, ends, _ = pre.cut(["b a b c a", "c b"])
    at, back = pre.distinct(code, starts, ends)
    names = [code[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len({names[k] for k in at}) == len(at) and [names[at[k]] for k in back] == names


def test_every_letter_in_words_encoded_as_one_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, pre, *_ = packing._tools(path)
    letters = np.flatnonzero(pre.classes == LETTER).tolist()
    texts = [" ".join(f" x{chr(c)} {chr(c)}y {chr(c)}" for c in letters[a : a + 2_000]) for a in range(0, len(letters), 2_000)]
    ids, offsets = packing.encode_ids(texts, path)
    for t, a, b in zip(texts, offsets, offsets[1:], strict=False):
        assert ids[a:b].tolist() == lib.encode(t, add_special_tokens=False).ids
