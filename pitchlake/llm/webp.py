"""Lossless WebP images in binary columns: a batch decoder, and an encoder for byte payloads.

A text is one image, 16 pixels (64 bytes) wide, up to 16,384 rows; the rest of a longer one is in further files after
it. The encoder looks at each image's content: few colours get a palette with packed pixels, pixels that resemble their
left or upper neighbours the predictor, and pixels come as literals, hits of the colour cache, or copies of earlier ones.

The decoder runs many images in lockstep: at each step every image that isn't finished gets one more pixel, by array
look-ups over all of them. It knows prefix codes (simple and normal, several groups through an entropy image),
back-references and the colour cache, and inverts the predictor, cross-colour, subtract-green and palette transforms.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import chunks, mix, read_table, text_bytes

#: Fixed values of the format: the order of code-length code lengths.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
TABLE_BITS = 15
HASH = np.uint32(0x1E35A7BD)
#: Near offsets (x left, y up) in the format's order: by distance, then by |x|, the right one of a pair first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
NEAR_X, NEAR_Y = (np.array(v) for v in zip(*NEAR, strict=True))


class Bits:
    """A reader of single fields, least significant bit first."""

    def __init__(self, data: bytes, at: int = 0) -> None:
        self.data, self.at = data, at

    def take(self, n: int) -> int:
        a, b = self.at >> 3, (self.at + n + 7) >> 3
        if b > len(self.data):
            raise ValueError("image data ends early")
        out = int.from_bytes(self.data[a:b], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out

    def peek(self, n: int) -> int:
        """The next n bits; zeros where the data end."""
        return int.from_bytes(self.data[self.at >> 3 : (self.at + n + 7) >> 3], "little") >> (self.at & 7) & ((1 << n) - 1)

    def symbol(self, table: np.ndarray) -> int:
        a = self.at >> 3
        entry = int(table[int.from_bytes(self.data[a : a + 3], "little") >> (self.at & 7) & 0x7FFF])
        self.at += entry & 15
        return entry >> 4


def canonical(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol → (code with its first bit lowest, length)."""
    out, code, last = {}, 0, 0
    for n, s in sorted((n, s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        last = n
        out[s] = int(f"{code:0{n}b}"[::-1], 2), n
        code += 1
    return out


def decoding_table(lengths: list[int]) -> np.ndarray:
    """For each next 15 bits: symbol * 16 + length. A code with one symbol takes no bits."""
    table = np.zeros(1 << TABLE_BITS, np.uint16)
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 1:
        table[:] = used[0] << 4
        return table
    if used and sum(1 << (TABLE_BITS - lengths[s]) for s in used) != 1 << TABLE_BITS:
        raise ValueError("prefix code isn't complete")
    for s, (code, n) in canonical(lengths).items():
        table[code :: 1 << n] = s << 4 | n
    return table


def read_code(bits: Bits, size: int) -> np.ndarray:
    lengths = [0] * size
    if bits.take(1):
        two = bits.take(1)
        lengths[bits.take(8 if bits.take(1) else 1)] = 1
        if two:
            lengths[bits.take(8)] = 1
        return decoding_table(lengths)
    own = [0] * 19
    for i in range(bits.take(4) + 4):
        own[CODE_LENGTH_ORDER[i]] = bits.take(3)
    table = decoding_table(own)
    left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        s = bits.symbol(table)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        if s == 16:
            n, value = 3 + bits.take(2), before
        else:
            n, value = (3 + bits.take(3) if s == 17 else 11 + bits.take(7)), 0
        lengths[at : at + n] = [value] * n
        at += n
    return decoding_table(lengths[:size])


@dataclass
class Stream:
    """What stands before an image's pixels, and where these begin."""

    width: int
    height: int
    at: int
    cache_bits: int
    tables: np.ndarray  # groups x 5 x 2**15
    groups: np.ndarray | None = None  # of each pixel
    transforms: list[tuple] = field(default_factory=list)
    out_width: int = 0


def read_stream(bits: Bits, width: int, height: int, main: bool, known: dict | None = None) -> Stream:
    """`known`: code tables met before, by the bits that describe them (no entropy image), so that they aren't built again."""
    for (as_main, n, blob), (cache_bits, tables) in (known or {}).items():
        if as_main == main and bits.peek(n) == blob:
            return Stream(width, height, bits.at + n, cache_bits, tables)
    begin = bits.at
    cache_bits = bits.take(4) if bits.take(1) else 0
    groups, n = None, 1
    if main and bits.take(1):
        by = bits.take(3) + 2
        image = sub_image(bits, -((-width) >> by), -((-height) >> by))
        w = -((-width) >> by)
        of = (image >> 8 & 0xFFFF).reshape(-1, w)
        groups = of[np.arange(height)[:, None] >> by, np.arange(width)[None, :] >> by].ravel()
        n = int(of.max()) + 1
    tables = np.stack([np.stack([read_code(bits, k) for k in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)]) for _ in range(n)])
    if known is not None and groups is None and len(known) < 32:
        n = bits.at - begin
        bits.at = begin
        known[main, n, bits.take(n)] = cache_bits, tables
    return Stream(width, height, bits.at, cache_bits, tables, groups)


def sub_image(bits: Bits, width: int, height: int, known: dict | None = None) -> np.ndarray:
    stream = read_stream(bits, width, height, False, known)
    begin = stream.at >> 3
    own = bits.data[begin : begin + 16 * width * height + 16]  # a pixel has fewer than 16 bytes
    pixels, ends = decode_lanes(own, [stream], [stream.at & 7])
    bits.at = 8 * begin + int(ends[0])
    return pixels[0]


def read_header(data: bytes, offset: int, known: dict | None = None) -> Stream:
    """The stream of the VP8L data that begins at byte `offset`."""
    bits = Bits(data, 8 * offset)
    if bits.take(8) != 0x2F:
        raise ValueError("not lossless WebP data")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    if bits.take(4) >> 1:
        raise ValueError("unknown version")
    transforms, own = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (PREDICTOR, CROSS_COLOUR):
            by = bits.take(3) + 2
            transforms.append((kind, own, by, sub_image(bits, -((-own) >> by), -((-height) >> by), known)))
        elif kind == PALETTE:
            n = bits.take(8) + 1
            colours = np.cumsum(sub_image(bits, n, 1, known).view(np.uint8).reshape(-1, 4), axis=0, dtype=np.uint8).view(np.uint32).ravel()
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, own, pack, colours))
            own = -((-own) >> pack)
        else:
            transforms.append((kind, own, 0, None))
    stream = read_stream(bits, own, height, True, known)
    stream.transforms, stream.out_width = transforms, width
    return stream


def _value(ahead: Callable[[np.ndarray], np.ndarray], pos: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A length or distance from its prefix symbol and extra bits; the positions after it."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    add = ahead(pos) & ((1 << extra) - 1)
    return np.where(prefix < 4, prefix, ((2 + (prefix & 1)) << extra) + add) + 1, pos + extra


def decode_lanes(data: bytes | np.ndarray, streams: list[Stream], starts: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """ARGB pixels of each stream, whose pixel data begin at the bit positions `starts` of `data`; and where they end."""
    raw = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    # the 64 bits that begin at each byte
    padded = np.concatenate([raw, np.zeros(16, np.uint8)])
    d64 = np.lib.stride_tricks.sliding_window_view(padded, 8).copy().view("<u8").ravel()
    last = len(d64) - 1
    sizes = np.array([s.width * s.height for s in streams], np.int64)
    order = np.argsort(-sizes, kind="stable")
    lanes, most = len(streams), int(sizes.max())
    sets: dict[int, int] = {}
    stacked: list[np.ndarray] = []
    base = np.zeros(lanes, np.int64)
    for k, i in enumerate(order):
        t = streams[i].tables
        if id(t) not in sets:
            sets[id(t)] = sum(map(len, stacked))
            stacked.append(t)
        base[k] = sets[id(t)]
    tables = np.concatenate(stacked).ravel()
    stride = 1 << TABLE_BITS
    base *= 5 * stride
    grouped = any(streams[i].groups is not None for i in order)
    group = np.zeros((lanes, most), np.int64) if grouped else None
    if grouped:
        for k, i in enumerate(order):
            if streams[i].groups is not None:
                group[k, : sizes[i]] = streams[i].groups * (5 * stride)
    live = np.searchsorted(-sizes[order], -np.arange(most), "left").tolist()  # lanes with a pixel t
    width = np.array([streams[i].width for i in order], np.int64)
    cbits = np.array([streams[i].cache_bits for i in order], np.int64)
    cached = int(cbits.max())
    plain = cached and (cbits == cached).all()
    store = np.zeros(lanes << cached, np.uint32) if cached else None
    shift = (32 - np.maximum(cbits, 1)).astype(np.uint32)
    row = np.arange(lanes, dtype=np.int64) << cached
    pos = np.array(starts, np.int64)[order]
    out = np.zeros((most, lanes), np.uint32)
    left, back = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    copying = 0

    def ahead(p: np.ndarray) -> np.ndarray:
        return (d64.take(p >> 3, mode="clip") >> (p & 7).view(np.uint64)).view(np.int64)

    # every lane decodes green, red, blue and alpha at once; what isn't a literal, or is in a copy, takes less of it
    for t in range(most):
        m = live[t]
        at = base[:m] + group[:m, t] if grouped else base[:m]
        p = pos[:m]
        bits = ahead(p)
        g = tables.take(at + (bits & 0x7FFF))
        s, used = g >> 4, (g & 15).astype(np.int64)
        n = used
        bits = bits >> n & 0x1FFFFFFFFFFFF
        r = tables.take(at + (stride + (bits & 0x7FFF)))
        n = n + (r & 15)
        bits = bits >> (r & 15)
        b = tables.take(at + (2 * stride + (bits & 0x7FFF)))
        n += b & 15
        a = tables.take(at + (3 * stride + (ahead(p + n) & 0x7FFF)))
        n += a & 15
        pixel = (s.astype(np.uint32) << 8) | ((r >> 4).astype(np.uint32) << 16) | (b >> 4) | ((a >> 4).astype(np.uint32) << 24)
        literal = s < 256
        if copying:
            busy = left[:m] > 0
            n[busy] = 0
            rest = np.flatnonzero(~(literal | busy))
        else:
            rest = np.flatnonzero(~literal)
        if len(rest):
            n[rest] = used[rest]
            kind = s[rest]
            hits = rest[kind >= 280]
            if len(hits):
                pixel[hits] = store[row[hits] + s[hits] - 280]
            refs = rest[kind < 280]
            if len(refs):
                length, q = _value(ahead, p[refs] + used[refs], s[refs].astype(np.int64) - 256)
                code = tables.take(at[refs] + (4 * stride + (ahead(q) & 0x7FFF)))
                dist, q = _value(ahead, q + (code & 15), (code >> 4).astype(np.int64))
                near = dist <= 120
                k = np.minimum(dist, 120) - 1
                dist = np.where(near, np.maximum(1, NEAR_X[k] + NEAR_Y[k] * width[refs]), dist - 120)
                if (dist > t).any():
                    raise ValueError("a reference to before the image")
                n[refs] = q - p[refs]
                left[refs], back[refs] = length - 1, dist
                pixel[refs] = out[t - dist, refs]
        p += n  # a view of pos
        if copying:
            copies = np.flatnonzero(busy)
            pixel[copies] = out[t - back[copies], copies]
            left[copies] -= 1
            copying -= int((left[copies] == 0).sum())
        if len(rest) and len(refs):
            copying += int((left[refs] > 0).sum())
        out[t, :m] = pixel
        if cached:
            key = (pixel * HASH) >> shift[:m]
            if not plain:
                key = np.where(cbits[:m] == 0, 0, key)
            store[row[:m] + key] = pixel
    if (pos > 8 * len(raw)).any() or last < 0:
        raise ValueError("image data ends early")
    pixels: list = [None] * lanes
    ends = np.zeros(lanes, np.int64)
    for k, i in enumerate(order):
        pixels[i], ends[i] = np.ascontiguousarray(out[: sizes[i], k]), pos[k]
    return pixels, ends


def _halves(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int32) + b) >> 1


def _predict(mode: int, left: np.ndarray, top: np.ndarray, topright: np.ndarray, topleft: np.ndarray) -> np.ndarray:
    """The prediction for one pixel from its neighbours (4 channels each)."""
    if mode in (0, 14, 15):
        return np.array([0, 0, 0, 255])
    if mode <= 4:
        return (left, top, topright, topleft)[mode - 1]
    if mode == 5:
        return _halves(_halves(left, topright), top)
    if mode <= 10:
        return (
            _halves(left, topleft), _halves(left, top), _halves(topleft, top), _halves(top, topright),
            _halves(_halves(left, topleft), _halves(top, topright))
        )[mode - 6]
    if mode == 11:
        guess = left + top - topleft
        return left if np.abs(guess - left).sum() < np.abs(guess - top).sum() else top
    if mode == 12:
        return np.clip(left + top - topleft, 0, 255)
    mean = _halves(left, top)
    change = mean - topleft
    return np.clip(mean + (change + (change < 0)) // 2, 0, 255)


def undo_predictor(px: np.ndarray, width: int, by: int, modes: np.ndarray) -> np.ndarray:
    height = len(px) // width
    x = px.view(np.uint8).reshape(height, width, 4).astype(np.int32)
    mode = (modes >> 8 & 15).reshape(-1, -((-width) >> by))
    x[0, 0] = (x[0, 0] + (0, 0, 0, 255)) & 255
    if mode.min() == mode.max() and mode.min() in (1, 2):  # the whole image at once: sums along rows, or along columns
        along = 1 if mode.min() == 1 else 0
        edge = x[:, 0] if along else x[0]
        edge[:] = np.cumsum(edge, axis=0)
        return np.cumsum(x, axis=along).astype(np.uint8).reshape(-1).view(np.uint32)
    x[0, 0] = (x[0, 0] - (0, 0, 0, 255)) & 255
    x[0, 0] = (x[0, 0] + (0, 0, 0, 255)) & 255
    x[0, 1:] = np.cumsum(x[0], axis=0)[1:] & 255
    for i in range(1, height):
        x[i, 0] = (x[i, 0] + x[i - 1, 0]) & 255
        above = x[i - 1]
        for j in range(1, width):
            right = above[j + 1] if j + 1 < width else x[i, 0]
            x[i, j] = (x[i, j] + _predict(int(mode[i >> by, j >> by]), x[i, j - 1], above[j], right, above[j - 1])) & 255
    return x.astype(np.uint8).reshape(-1).view(np.uint32)


def undo_cross_colour(px: np.ndarray, width: int, by: int, factors: np.ndarray) -> np.ndarray:
    height = len(px) // width
    x = px.view(np.uint8).reshape(height, width, 4)
    f = factors.view(np.int8).reshape(-1, -((-width) >> by), 4).astype(np.int32)[np.arange(height)[:, None] >> by, np.arange(width)[None, :] >> by]
    signed = lambda c: c.astype(np.int8).astype(np.int32)
    green, out = signed(x[..., 1]), x.copy()
    red = (x[..., 2] + (f[..., 0] * green >> 5)).astype(np.uint8)
    blue = x[..., 0] + (f[..., 1] * green >> 5) + (f[..., 2] * signed(red) >> 5)
    out[..., 2], out[..., 0] = red, blue.astype(np.uint8)
    return out.reshape(-1).view(np.uint32)


def undo_palette(px: np.ndarray, width: int, pack: int, colours: np.ndarray) -> np.ndarray:
    """Each pixel's green holds the indexes of 2**pack pixels, the first in the lowest bits."""
    narrow = -((-width) >> pack)
    green = (px >> 8 & 255).reshape(-1, narrow)
    bits = 8 >> pack
    index = green[:, np.arange(width) >> pack] >> ((np.arange(width) & ((1 << pack) - 1)) * bits).astype(np.uint32) & ((1 << bits) - 1)
    known = np.zeros(256, np.uint32)
    known[: len(colours)] = colours
    return known[index].ravel()


def finish(stream: Stream, px: np.ndarray) -> np.ndarray:
    for kind, width, by, data in reversed(stream.transforms):
        if kind == PREDICTOR:
            px = undo_predictor(px, width, by, data)
        elif kind == CROSS_COLOUR:
            px = undo_cross_colour(px, width, by, data)
        elif kind == PALETTE:
            px = undo_palette(px, width, by, data)
        else:
            x = px.view(np.uint8).reshape(-1, 4).copy()
            x[:, 0] += x[:, 1]
            x[:, 2] += x[:, 1]
            px = x.reshape(-1).view(np.uint32)
    return px


def files_in(data: bytes) -> list[int]:
    """The offsets of the VP8L data of the WebP files that stand one after another in `data`."""
    out, at = [], 0
    while at < len(data):
        if data[at : at + 4] != b"RIFF" or data[at + 8 : at + 16] != b"WEBPVP8L":
            raise ValueError("not a simple lossless WebP file")
        out.append(at + 20)
        at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
    return out


def decode_batch(media: list[bytes], known: dict | None = None) -> list[list[np.ndarray]]:
    """For each value its images as height x width x 4 arrays (B, G, R, A). `known`: code tables seen before."""
    joined = b"".join(media)
    streams, offset = [], 0
    counts = []
    known = {} if known is None else known
    for m in media:
        at = files_in(m)
        counts.append(len(at))
        streams += [read_header(joined, offset + a, known) for a in at]
        offset += len(m)
    if not streams:
        return [[] for _ in media]
    pixels, _ = decode_lanes(joined, streams, [s.at for s in streams])
    images = [finish(s, p).view(np.uint8).reshape(s.height, s.out_width, 4) for s, p in zip(streams, pixels, strict=True)]
    out, k = [], 0
    for n in counts:
        out.append(images[k : k + n])
        k += n
    return out


# ---------------------------------------------------------------------------------------------------------------------
# The encoder: every 64 bytes are a row of 16 pixels, so green, red, blue and alpha are payload bytes. Fixed sets of prefix
# codes serve all images: one for texts, one for residuals of the predictor, which are mostly 0.

WIDTH, MOST_ROWS, CACHE_BITS = 16, 1 << 14, 8
MOST_BYTES = 4 * WIDTH * MOST_ROWS
#: Pixels that a copy has at least and at most.
COPY, MOST_COPY = 4, 4096
#: A palette with at most so many colours is tried, in images of so many pixels at least.
COLOURS, LEAST_PIXELS = 16, 128
#: Pixels of images that are decoded together, as if all were as large as the largest.
AREA = 6 << 20
#: Bits that the predictor must save.
OVERHEAD = 512


def huffman_lengths(weights: list[int]) -> list[int]:
    """Code lengths for the weights (0: no code); the weights' range keeps them within 15 bits."""
    heap = [(w, s, (s,)) for s, w in enumerate(weights) if w]
    heapq.heapify(heap)
    lengths = [0] * len(weights)
    while len(heap) > 1:
        (a, i, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            lengths[s] += 1
        heapq.heappush(heap, (a + b, i, x + y))
    return lengths


def byte_weights() -> list[int]:
    """A rule for text: blank and small letters often, marks, digits, capitals and upper bytes less, the rest seldom."""
    return [
        1024 if b == 0x20 else 256 if chr(b) in "aeinorsth" else 96 if 0x61 <= b <= 0x7A else 24 if b in b"\n.,\0" or 0x80 <= b < 0xD0 else 6 if 0x21 <= b < 0x7F else 1 for b in range(256)
    ]


def _code_bits(lengths: list[int]) -> list[tuple[int, int]]:
    """A normal prefix code's description as (value, bits) fields."""
    tokens: list[tuple[int, int, int]] = []  # symbol, extra, bits of extra
    i = 0
    while i < len(lengths):
        value, n = lengths[i], 1
        while i + n < len(lengths) and lengths[i + n] == value:
            n += 1
        i += n
        if value:
            tokens.append((value, 0, 0))
            n -= 1
        while n >= 3:
            k = min(n, 6 if value else 138)
            tokens.append((16, k - 3, 2) if value else (17, k - 3, 3) if k <= 10 else (18, k - 11, 7))
            n -= k
        tokens += [(value, 0, 0)] * n
    weights = [0] * 19
    for s, _, _ in tokens:
        weights[s] += 1
    own = _limited(weights, 7)
    codes = canonical(own)
    out = [(0, 1), (15, 4), *((own[s], 3) for s in CODE_LENGTH_ORDER), (0, 1)]
    for s, extra, bits in tokens:
        out += [codes[s], (extra, bits)] if bits else [codes[s]]
    return out


def _limited(weights: list[int], most: int) -> list[int]:
    """huffman_lengths with the weights flattened until no code is longer than `most`."""
    while max(lengths := huffman_lengths(weights)) > most:
        weights = [w and (w + 1) // 2 for w in weights]
    return lengths


def residual_weights() -> list[int]:
    """A rule for differences of neighbouring pixels that resemble each other: 0 mostly, small ones sometimes."""
    return [4096 if b == 0 else 64 if min(b, 256 - b) < 8 else 4 for b in range(256)]


def _packed(fields: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(value, bits) fields as fields of 32 bits and a rest."""
    value, n = 0, 0
    for v, k in fields:
        value |= v << n
        n += k
    return [(value >> i & 0xFFFFFFFF, min(32, n - i)) for i in range(0, n, 32)]


def _codes(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    codes = canonical(lengths)
    return tuple(np.array([codes.get(s, (0, 0))[i] for s in range(len(lengths))], np.uint64) for i in range(2))


@cache
def encoder(kind: str) -> tuple[list[tuple[int, int]], tuple, tuple, tuple]:
    """For "text" or "residual": fields of the codes' description; codes and lengths of green (with lengths and cache), of the other channels, and of distances."""
    each = byte_weights() if kind == "text" else residual_weights()
    total = sum(each)
    green = _limited([8 * w for w in each] + [max(1, total // 200)] * 24 + [max(1, total // 120)] * (1 << CACHE_BITS), 15)
    plain = _limited(each, 15)
    far = _limited([1 + i // 4 for i in range(40)], 15)
    fields = [(1, 1), (CACHE_BITS, 4), (0, 1), *_code_bits(green), *(_code_bits(plain) * 3), *_code_bits(far)]
    return _packed(fields), _codes(green), _codes(plain), _codes(far)


NOTHING = [(1, 1), (0, 1), (0, 1), (0, 1)]  # a code with the one symbol 0


def predictor_fields(mode: int) -> list[tuple[int, int]]:
    """One mode for the whole image, in blocks of 512 by 512."""
    return [(1, 1), (PREDICTOR, 2), (7, 3), (0, 1), (1, 1), (0, 1), (1, 1), (mode, 8), *(NOTHING * 4)]


def palette_fields(colours: np.ndarray) -> list[tuple[int, int]]:
    """Colours as differences, each byte by a code of eight bits."""
    flat = [8] * 256
    values = canonical(flat)
    steps = np.diff(colours.view(np.uint8).reshape(-1, 4), axis=0, prepend=np.zeros((1, 4), np.uint8))
    bytes_ = [values[int(x[i])] for x in steps for i in (1, 2, 0, 3)]
    return [(1, 1), (PALETTE, 2), (len(colours) - 1, 8), (0, 1), *_code_bits([*flat, *[0] * 24]), *(_code_bits(flat) * 3), *NOTHING, *bytes_]


def _pack_bits(values: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fields into 64-bit words; `first`: index of each image's first field. Images begin at word borders.
    Returns the words, each image's first word and its bits."""
    run = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    bits = np.diff(np.append(run[first], run[-1]))
    words = (bits + 63) // 64
    begin = np.cumsum(words) - words
    count = np.diff(np.append(first, len(sizes)))
    pos = run[:-1] + np.repeat(begin * 64 - run[first], count)
    word, shift = pos >> 6, (pos & 63).astype(np.uint64)
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[starts]] |= np.bitwise_or.reduceat(values << shift, starts)
    over = np.flatnonzero(shift + sizes.astype(np.uint64) > 64)
    out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out[:-1], begin, bits


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths or distances from 1 on as prefix symbol, extra bits' number and value."""
    m = v - 1
    high = np.where(m < 4, 0, np.frexp(np.maximum(m, 1).astype(np.float64))[1] - 1)
    extra = np.where(m < 4, 0, high - 1)
    symbol = np.where(m < 4, m, 2 * high + (m >> np.maximum(high - 1, 0) & 1))
    return symbol, extra, np.where(m < 4, 0, m & ((1 << extra) - 1))


def _copies(px: np.ndarray, image: np.ndarray) -> list[tuple[int, int, int]]:
    """(pixel, length, distance) of copies of earlier pixels of the same image, in order and apart.

    Places where the next COPY pixels were last seen at one distance make a run."""
    n = len(px) - COPY + 1
    if n < 2:
        return []
    h = image[:n].astype(np.uint64)
    for j in range(COPY):
        h = mix(h) + px[j : j + n]
    order = np.argsort(h, kind="stable")
    order = order[image[order] == image[order + COPY - 1]]
    back = np.zeros(n, np.int64)
    same = h[order[1:]] == h[order[:-1]]
    here, before = order[1:][same], order[:-1][same]
    equal = image[here] == image[before]
    for j in range(COPY):
        equal &= px[here + j] == px[before + j]
    back[here[equal]] = (here - before)[equal]
    found = back > 0
    begins = np.flatnonzero(found & np.append(True, back[1:] != back[:-1]))
    ends = np.append(np.flatnonzero(np.append(back[1:] != back[:-1], True) & found), 0)[: len(begins)] + COPY
    out, free = [], 0
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        d, a = int(back[a]), max(a, free)
        while b - a >= COPY:
            k = min(b - a, MOST_COPY)
            out.append((a, k, d))
            a = free = a + k
    return out


def _emit(px: np.ndarray, count: np.ndarray, height: np.ndarray, kind: str, transforms: list[list[tuple[int, int]]]) -> list[bytes]:
    """A WebP file for each image: `count` are its (perhaps packed) pixels in `px`, end to end; `height` its rows."""
    header, (gc, gn), (pc, pn), (dc, dn) = encoder(kind)
    first = np.cumsum(count) - count
    n, k = len(px), len(count)
    image = np.repeat(np.arange(k), count)
    # the colour cache holds the last pixel with each key
    key = ((px * HASH) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)
    group = image << CACHE_BITS | key
    order = np.argsort(group, kind="stable")
    group = group[order]
    hit = np.zeros(n, bool)
    hit[order[1:]] = (group[1:] == group[:-1]) & (px[order[1:]] == px[order[:-1]])
    c = px.view(np.uint8).reshape(-1, 4)
    b, g, r, a = (c[:, i].astype(np.intp) for i in range(4))
    values, sizes = gc[g].copy(), gn[g].copy()
    for ch in (r, b, a):
        values |= pc[ch] << sizes
        sizes += pn[ch]
    values[hit], sizes[hit] = gc[280 + key[hit]], gn[280 + key[hit]]
    emit = np.ones(n, bool)
    if copies := _copies(px, image):
        at, length, distance = (np.array(x, np.int64) for x in zip(*copies, strict=True))
        edges = np.zeros(n + 1, np.int64)
        edges[at + 1] += 1
        edges[at + length] -= 1
        emit = np.cumsum(edges)[:n] == 0
        total, bits = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for (codes, lengths), base, v in (((gc, gn), 256, length), ((dc, dn), 0, distance + 120)):
            symbol, extra, add = _prefix(v)
            total |= codes[base + symbol] << bits
            bits += lengths[base + symbol]
            total |= add.astype(np.uint64) << bits
            bits += extra.astype(np.uint64)
        values[at], sizes[at] = total, bits
    values, sizes = values[emit], sizes[emit]
    kept = np.cumsum(np.concatenate([[0], emit]))[first]
    heads = [
        [*_packed([(0x2F, 8), (WIDTH - 1, 14), (h - 1, 14), (1, 1), (0, 3), *own, (0, 1)]), *header] for h,
        own in zip(height.tolist(), transforms, strict=True)
    ]
    lead = np.array([len(x) for x in heads])
    each = np.diff(np.append(kept, len(values))) + lead
    at = np.cumsum(each) - each
    every, every_n = np.zeros(int(each.sum()), np.uint64), np.zeros(int(each.sum()), np.uint64)
    own = np.repeat(at, lead) + np.arange(lead.sum()) - np.repeat(np.cumsum(lead) - lead, lead)
    flat = np.array([x for h in heads for x in h], np.uint64)
    every[own], every_n[own] = flat[:, 0], flat[:, 1]
    body = np.ones(len(every), bool)
    body[own] = False
    every[body], every_n[body] = values, sizes
    words, begin, bits = _pack_bits(every, every_n, at)
    raw = words.astype("<u8").tobytes()
    out = []
    for w, nbits in zip(begin.tolist(), bits.tolist(), strict=True):
        size = (nbits + 7) // 8
        pad = size & 1
        out.append(b"RIFF" + (12 + size + pad).to_bytes(4, "little") + b"WEBPVP8L" + size.to_bytes(4, "little") + raw[8 * w : 8 * w + size] + b"\0" * pad)
    return out


def _residuals(px: np.ndarray, row: np.ndarray) -> dict[int, np.ndarray]:
    """What the predictor leaves of pixels by left (1) and by upper (2) neighbours; `row`: each pixel's row in its image."""
    c = px.view(np.uint8).reshape(-1, WIDTH, 4)
    left, top = c.copy(), c.copy()
    head, rest = row[::WIDTH] == 0, row[::WIDTH] > 0
    left[:, 1:] -= c[:, :-1]
    up = np.zeros_like(c)
    up[1:] = c[:-1]
    left[rest, 0] -= up[rest, 0]
    top[rest] -= up[rest]
    top[head, 1:] -= c[head, :-1]
    for x in (left, top):
        x[head, 0, 3] -= np.uint8(255)  # the first pixel's prediction is opaque black
    return {1: left.reshape(-1).view(np.uint32), 2: top.reshape(-1).view(np.uint32)}


def encode_images(payload: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A WebP file for each image: `sizes` are its bytes in `payload` (multiples of 64, MOST_BYTES at most), end to end."""
    px, count = payload.view(np.uint32), sizes // 4
    first = np.cumsum(count) - count
    image = np.repeat(np.arange(len(count)), count)
    # few colours: looked for where the first pixels have few
    large = np.flatnonzero(count >= LEAST_PIXELS)
    lead = np.sort(px[first[large][:, None] + np.arange(LEAST_PIXELS)], axis=1)
    large = large[(lead[:, 1:] != lead[:, :-1]).sum(axis=1) < COLOURS]
    palette = [i for i in large.tolist() if len(np.unique(px[first[i] : first[i] + count[i]])) <= COLOURS]
    # bits of literals by the codes for texts, or for residuals
    bits = lambda x, kind: np.add.reduceat(
        (lambda c, g, p: g[c[:, 1]] + p[c[:, 0]] + p[c[:, 2]] + p[c[:, 3]])(
            x.view(np.uint8).reshape(-1, 4), encoder(kind)[1][1][:256].astype(np.int64), encoder(kind)[2][1].astype(np.int64)
        ),
        first
    )
    left = _residuals(px, (np.arange(len(px)) - np.repeat(first, count)) // WIDTH)
    cost = np.stack([bits(px, "text"), bits(left[1], "residual") + OVERHEAD, bits(left[2], "residual") + OVERHEAD])
    mode = cost.argmin(axis=0)
    mode[palette] = 3
    out: list[bytes] = [b""] * len(count)
    for m, kind in ((0, "text"), (1, "residual"), (2, "residual")):
        if len(own := np.flatnonzero(mode == m)):
            pixels = (left[m] if m else px)[np.isin(image, own)] if len(own) < len(count) else (left[m] if m else px)
            for i, f in zip(own.tolist(), _emit(pixels, count[own], count[own] // WIDTH, kind, [predictor_fields(m) if m else []] * len(own)), strict=True):
                out[i] = f
    for i in np.flatnonzero(mode == 3).tolist():
        known, index = np.unique(px[first[i] : first[i] + count[i]], return_inverse=True)
        pack = 3 if len(known) <= 2 else 2 if len(known) <= 4 else 1
        each = 1 << pack
        packed = (index.reshape(-1, each).astype(np.uint32) << (np.arange(each) * (8 >> pack)).astype(np.uint32)).sum(axis=1).astype(np.uint32)
        [out[i]] = _emit(packed << np.uint32(8) | np.uint32(255 << 24), np.array([len(packed)]), count[i : i + 1] // WIDTH, "residual", [palette_fields(known)])
    return out


def encode_payloads(payload: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Each payload (of `sizes` bytes, multiples of 64) as one WebP file; beyond MOST_BYTES as several, one after another."""
    n = -(-sizes // MOST_BYTES)
    parts = np.full(int(n.sum()), MOST_BYTES, np.int64)
    parts[np.cumsum(n) - 1] = sizes - (n - 1) * MOST_BYTES
    files = encode_images(payload, parts)
    edge = np.concatenate([[0], np.cumsum(n)]).tolist()
    return [b"".join(files[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = 6 << 20) -> DataFrame:
    """Per row: id, media (binary: WebP files), n_bytes. The text's UTF-8 bytes, filled up with zeros to a positive
    multiple of 64; a null text counts as empty. Rows may repeat; extra columns are not read. An empty table gives no rows.
    Of coding choices that tie in bits the first is taken (text, left, upper, palette), so equal texts give equal files. A
    text beyond MOST_BYTES is several files one after another; all its files are in memory together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets, chunk_bytes):
                n = np.diff(offsets[a : b + 1])
                sizes = np.maximum(64, -(-n // 64) * 64)
                payload = np.zeros(int(sizes.sum()), np.uint8)
                begin = np.cumsum(sizes) - sizes
                payload[np.arange(int(n.sum())) + np.repeat(begin - (offsets[a:b] - offsets[a]), n)] = raw[offsets[a] : offsets[b]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(encode_payloads(payload, sizes), pa.binary()), pa.array(n)],
                    names=["id", "media", "n_bytes"]
                )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {docs.schema[id_col].dataType.simpleString()}, media binary, n_bytes long"
    ).withColumnRenamed("id", id_col)


def _alike(pixels: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of images in rising order of size whose number times the largest is at most AREA (one image at least)."""
    i = 0
    while i < len(pixels):
        j = i + 1
        while j < len(pixels) and pixels[j] * (j + 1 - i) <= AREA:
            j += 1
        yield i, j
        i = j


def read_payloads(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode `media` and compute what the pixels say: sizes, checksums, and the feature: the number of bytes with each
    upper half (16 counts) and the mean byte.

    stored: id, media and n_bytes as `store_texts` wrote them; extra columns, also of the names that come out, are not read. Rows may
    repeat, ids may be null; an empty table gives no rows. A file of a MB is decoded in as many steps as it has pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            # images are decoded in lockstep, so those of like size go together
            batch = batch.take(pa.array(np.argsort(batch.column(2).to_numpy(), kind="stable")))
            for a, b in _alike(batch.column(2).to_numpy() // 4 + WIDTH):
                media = batch.column(1).slice(a, b - a).to_pylist()
                rows = []
                for m, images in zip(media, decode_batch(media, known), strict=True):
                    data = b"".join(x.tobytes() for x in images)
                    x = np.frombuffer(data, np.uint8)
                    upper = np.bincount(x >> 4, minlength=16)
                    rows.append(
                        (
                            len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(m), hashlib.sha256(m).hexdigest(),
                            "{}|{:.4f}".format(",".join(map(str, upper)), x.mean())
                        )
                    )
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), *(pa.array(list(c)) for c in zip(*rows, strict=True))],
                    names=["id", *OUT]
                )

    return stored.select(F.col(id_col).alias("id"), "media", "n_bytes").mapInArrow(
        run,
        f"id {stored.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    ).withColumnRenamed("id", id_col)


OUT = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_payloads(store_texts(read_table(spark, sf_dir, "documents")))
