"""Pre-tokens of whole batches as arrays: where each begins, and a 64-bit hash of each, without a Python object a token.

The two tokenizers used here first cut a text by a pattern and then encode each pre-token on its own, so a text's ids
are its pre-tokens' ids, one after another. `Pretokens` finds the cuts by character classes over code-point arrays.
Texts for which that wouldn't hold go to the tokenizer whole (`odd`)."""

from __future__ import annotations

import sys
import unicodedata
from itertools import islice

import numpy as np
import pyarrow as pa

from .base import mix, ragged

LETTER, NUMBER, SPACE, OTHER, ODD = 1, 2, 3, 0, 4
#: The code points with the White_Space property.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 2**64))


def character_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter(
        (ODD if (c := unicodedata.category(chr(i))) in ("Cn", "Cs", "Co") else kinds.get(c[0], OTHER) for i in range(sys.maxunicode + 1)), np.uint8,
        sys.maxunicode + 1
    )
    out[WHITE_SPACE] = SPACE
    return out


class Cache:
    """A bounded table of a worker, in two halves: when the young one is full it becomes the old one, and what is used
    again moves back, so that frequent entries stay."""

    def __init__(self, size: int) -> None:
        self.half, self.young, self.old = size // 2, {}, {}

    def get_all(self, words: list[str]) -> list:
        """The value of each word, None for those that aren't there."""
        out = list(map(self.young.get, words))
        if self.old and None in out:
            miss = [k for k, x in enumerate(out) if x is None]
            again = {k: x for k, x in zip(miss, map(self.old.get, [words[k] for k in miss]), strict=True) if x is not None}
            for k, x in again.items():
                out[k] = x
            self.young.update(zip([words[k] for k in again], again.values(), strict=True))
        return out

    def add(self, words: list[str], values: list) -> None:
        if len(self.young) + len(words) > self.half:
            self.old, self.young = self.young, {}
        self.young.update(zip(words[: self.half], values[: self.half], strict=True))

    def trim(self, most: int) -> None:
        """Keep the `most` latest entries only."""
        self.old, self.young = {}, dict(islice(self.young.items(), max(0, len(self.young) - most), None))


class Pretokens:
    """lower: the pattern of the lower-casing word vocabulary (white space dropped, digits single); else that of the byte-level one."""

    def __init__(self, lower: bool, special: tuple[str, ...]) -> None:
        self.lower, self.special = lower, special
        self.classes = character_classes()
        self.power = self.unpower = np.ones(1, np.uint64)

    def odd(self, texts: list[str]) -> list[bool]:
        """Which texts must go to the tokenizer whole: those with a special token's string, with a code point that Python's
        tables don't know (the libraries' own, newer tables may), and, for the lower-casing vocabulary, those that aren't
        normalized or have the one letter that lower-cases to two."""
        out = ["<|" in t and any(s in t for s in self.special) for t in texts]
        wide = [i for i, t in enumerate(texts) if not t.isascii()]
        if not wide:
            return out
        if self.lower:
            for i in wide:
                out[i] = out[i] or not unicodedata.is_normalized("NFC", texts[i]) or "İ" in texts[i]
        code = np.frombuffer("".join(texts[i] for i in wide).encode("utf-32-le", "surrogatepass"), np.uint32)
        unknown = np.flatnonzero(self.classes[code] == ODD)
        if len(unknown):
            ends = np.cumsum([len(texts[i]) for i in wide])
            for k in np.unique(np.searchsorted(ends, unknown, "right")).tolist():
                out[wide[k]] = True
        return out

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, begin and end of each pre-token in them, and the number of pre-tokens of each text."""
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
        n = len(code)
        if not n:
            return code, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        kind = self.classes[code]
        first = np.zeros(n + 1, bool)
        first[edges] = True
        before = np.empty(n, np.uint8)
        before[0], before[1:] = 9, kind[:-1]
        before[first[:n]] = 9
        space = kind == SPACE
        begins = kind != before
        if self.lower:
            begins |= kind == NUMBER
        else:
            blank = code == 0x20
            led = np.zeros(n, bool)  # a blank just before belongs to what follows
            led[1:] = blank[:-1] & ~first[1:n]
            begins &= ~(led & ~space)
            last = np.zeros(n, bool)  # the last of a run of white space before something else
            last[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
            begins |= last
        self._contractions(code, kind, first, begins)
        if self.lower:
            starts = np.flatnonzero(begins)
            ends = np.append(starts[1:], n)
            solid = ~space[starts]
            starts, ends = starts[solid], ends[solid]
        else:
            starts = np.flatnonzero(begins)
            ends = np.append(starts[1:], n)
        return code, starts, ends, np.diff(np.searchsorted(starts, edges))

    def _contractions(self, code: np.ndarray, kind: np.ndarray, first: np.ndarray, begins: np.ndarray) -> None:
        """'s 't 'm 'd 're 've 'll are pre-tokens where an apostrophe begins one."""
        n = len(code)
        at = np.flatnonzero((code == 0x27) & begins)
        if not len(at):
            return
        fold = (lambda c: np.where((c >= 0x41) & (c <= 0x5A), c + 0x20, c)) if self.lower else (lambda c: c)
        inside = lambda i: np.where(i < n, np.minimum(i, n - 1), 0)
        one, two = at + 1, at + 2
        has1 = (one < n) & ~first[np.minimum(one, n)]
        has2 = has1 & (two < n) & ~first[np.minimum(two, n)]
        c1, c2 = fold(code[inside(one)]), fold(code[inside(two)])
        short = has1 & np.isin(c1, [ord(x) for x in "stmd"])
        long = has2 & (((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | ((c1 == ord("l")) & (c2 == ord("l"))))
        for here, length in ((at[short], 2), (at[long], 3)):
            for j in range(1, length):
                begins[here + j] = False
            after = here + length
            after = after[after < n]
            after = after[kind[after] == LETTER]
            begins[after] = True

    def distinct(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One place of each distinct pre-token, and for each pre-token the number of its place. They are brought together
        by hash, and compared with their place's code points; one that differs gets a place of its own."""
        back = pa.array(self.hashes(code, starts, ends)).dictionary_encode().indices.to_numpy().astype(np.int64)
        at = np.flatnonzero(np.diff(np.maximum.accumulate(back), prepend=-1))  # numbers are given by first place
        n, like = ends - starts, at[back]
        even = np.flatnonzero(n == n[like])
        differ = np.ones(len(n), bool)
        if len(even):
            first = np.cumsum(n[even]) - n[even]
            unlike = code[ragged(starts[even], n[even])] != code[ragged(starts[like[even]], n[even])]
            differ[even] = np.logical_or.reduceat(unlike, first)
        own: dict[bytes, int] = {}
        more: list[int] = []
        for k in np.flatnonzero(differ).tolist():
            name = code[starts[k] : ends[k]].tobytes()
            if name not in own:
                own[name] = len(at) + len(more)
                more.append(k)
            back[k] = own[name]
        return np.concatenate([at, np.array(more, np.int64)]), back

    def hashes(self, code: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A polynomial modulo 2**64 of each: quick, and enough to bring equal ones together, as `distinct` compares them."""
        if len(self.power) <= len(code):
            n = max(len(code) + 1, 1 << 16)
            self.power, self.unpower = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)])) for b in (BASE, UNBASE))
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(mix(code.astype(np.uint64) + np.uint64(0x51ED27)) * self.power[: len(code)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.unpower[starts] + (ends - starts).astype(np.uint64))
