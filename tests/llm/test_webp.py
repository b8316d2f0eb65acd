"""The WebP decoder on streams written here, with every transform and kind of reference; the encoder's choices."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from pitchlake.llm import webp as W  # noqa: E402

FLAT = [8] * 256
ONE = [(1, 1), (0, 1), (0, 1), (0, 1)]  # the symbol 0


def pack(fields):
    value, n = 0, 0
    for v, k in fields:
        value |= v << n
        n += k
    data = value.to_bytes((n + 7) // 8, "little")
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + (12 + len(data)).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + data


def head(width, height):
    return [(0x2F, 8), (width - 1, 14), (height - 1, 14), (1, 1), (0, 3)]


def codes(cache=0, distance=False):
    """Every byte by eight bits; with lengths, cache and distances a green code and a distance code that have them."""
    if not distance and not cache:
        return [*W._code_bits([*FLAT, *[0] * 24]), *(W._code_bits(FLAT) * 3), *ONE], [*FLAT, *[0] * 24], [0] * 40
    green = W.huffman_lengths([1000] * 256 + [300] * 24 + [300] * (1 << cache if cache else 0))
    far = W.huffman_lengths([1] * 40)
    return [*W._code_bits(green), *(W._code_bits(FLAT) * 3), *W._code_bits(far)], green, far


def literals(px, green=None):
    """Fields of pixels (rows of B, G, R, A)."""
    g, flat = W.canonical(green or FLAT), W.canonical(FLAT)
    return [f for b, gr, r, a in px for f in (g[gr], flat[r], flat[b], flat[a])]


def small(px):
    """A sub-image: no cache, flat codes."""
    return [(0, 1), *codes()[0], *literals(px)]


def decode(fields):
    [[image]] = W.decode_batch([pack(fields)])
    return image.astype(int).reshape(-1, 4).tolist()


def picture(width, height, seed=1, colours=None):
    rng = random.Random(seed)
    pool = [[rng.randrange(256) for _ in range(4)] for _ in range(colours or 0)]
    return [list(rng.choice(pool)) if colours else [rng.randrange(256) for _ in range(4)] for _ in range(width * height)]


def average(a, b):
    return [(x + y) // 2 for x, y in zip(a, b, strict=True)]


def clamp(x):
    return max(0, min(255, x))


def guess(mode, left, top, right, corner):
    """The format's predictions, channel by channel."""
    if mode == 11:
        about = [le + t - c for le, t, c in zip(left, top, corner, strict=True)]
        return left if sum(abs(p - x) for p, x in zip(about, left, strict=True)) < sum(abs(p - x) for p, x in zip(about, top, strict=True)) else top
    if mode == 12:
        return [clamp(le + t - c) for le, t, c in zip(left, top, corner, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(average(left, top), corner, strict=True)]
    return {
        0: [0, 0, 0, 255], 1: left, 2: top, 3: right, 4: corner, 5: average(average(left, right), top), 6: average(left, corner), 7: average(left, top),
        8: average(corner, top), 9: average(top, right), 10: average(average(left, corner), average(top, right)),
    }[mode]


def predicted(px, width, by, modes):
    out, blocks = [], -(-width >> by)
    for i, x in enumerate(px):
        row, col = divmod(i, width)
        if i == 0:
            p = [0, 0, 0, 255]
        elif row == 0:
            p = px[i - 1]
        elif col == 0:
            p = px[i - width]
        else:
            p = guess(modes[(row >> by) * blocks + (col >> by)], px[i - 1], px[i - width], px[i - width + 1], px[i - width - 1])
        out.append([(a - b) % 256 for a, b in zip(x, p, strict=True)])
    return out


def block_image(values):
    return [[0, v, 0, 255] for v in values]


@pytest.mark.parametrize("mode", range(14))
def test_predictor_modes(mode):
    width, height = 7, 6
    px = picture(width, height, mode)
    fields = [
        *head(width, height), (1, 1), (W.PREDICTOR, 2), (0, 3), *small(block_image([mode] * 4)), (0, 1), (0, 1), (0, 1), *codes()[0],
        *literals(predicted(px, width, 2, [mode] * 4))
    ]
    assert decode(fields) == px


def test_predictor_blocks():
    width, height = 13, 9
    modes = [random.Random(4).randrange(14) for _ in range(12)]
    px = picture(width, height, 5)
    fields = [
        *head(width, height), (1, 1), (W.PREDICTOR, 2), (0, 3), *small(block_image(modes)), (0, 1), (0, 1), (0, 1), *codes()[0],
        *literals(predicted(px, width, 2, modes))
    ]
    assert decode(fields) == px


def signed(x):
    return x - 256 if x > 127 else x


def crossed(px, width, by, factors):
    """factors: (green to red, green to blue, red to blue) of each block."""
    out, blocks = [], -(-width >> by)
    for i, (b, g, r, a) in enumerate(px):
        row, col = divmod(i, width)
        gr, gb, rb = (signed(f) for f in factors[(row >> by) * blocks + (col >> by)])
        out.append([(b - (gb * signed(g) >> 5) - (rb * signed(r) >> 5)) % 256, g, (r - (gr * signed(g) >> 5)) % 256, a])
    return out


def test_cross_colour():
    width, height = 9, 5
    px = picture(width, height, 6)
    factors = [[random.Random(i).randrange(256) for _ in range(3)] for i in range(6)]
    fields = [
        *head(width, height), (1, 1), (W.CROSS_COLOUR, 2), (0, 3), *small([[gr, gb, rb, 255] for gr, gb, rb in factors]), (0, 1), (0, 1), (0, 1),
        *codes()[0], *literals(crossed(px, width, 2, factors))
    ]
    assert decode(fields) == px


def less_green(px):
    return [[(b - g) % 256, g, (r - g) % 256, a] for b, g, r, a in px]


def test_subtract_green():
    px = picture(5, 4, 7)
    assert decode([*head(5, 4), (1, 1), (W.SUBTRACT_GREEN, 2), (0, 1), (0, 1), (0, 1), *codes()[0], *literals(less_green(px))]) == px


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 9, 16, 17, 200])
def test_palette(colours):
    width, height = 11, 12
    px = picture(width, height, colours, colours)
    known = sorted({tuple(x) for x in px})
    steps = [[(a - b) % 256 for a, b in zip(x, before, strict=True)] for before, x in zip([(0, 0, 0, 0), *known], known, strict=False)]
    pack_ = 3 if len(known) <= 2 else 2 if len(known) <= 4 else 1 if len(known) <= 16 else 0
    each, bits = 1 << pack_, 8 >> pack_
    index = [known.index(tuple(x)) for x in px]
    packed = []
    for row in range(height):
        line = index[row * width : (row + 1) * width]
        packed += [[0, sum(v << (bits * j) for j, v in enumerate(line[k : k + each])), 0, 255] for k in range(0, width, each)]
    fields = [*head(width, height), (1, 1), (W.PALETTE, 2), (len(known) - 1, 8), *small(steps), (0, 1), (0, 1), (0, 1), *codes()[0], *literals(packed)]
    assert decode(fields) == px


def test_transforms_together():
    """Predictor, then cross-colour, then subtract-green; undone from the last to the first."""
    width, height = 8, 8
    px = picture(width, height, 8)
    modes, factors = [1, 11, 12, 2], [[3, 250, 17], [128, 1, 255], [0, 0, 0], [77, 200, 9]]
    body = less_green(crossed(predicted(px, width, 2, modes), width, 2, factors))
    fields = [
        *head(width, height), (1, 1), (W.PREDICTOR, 2), (0, 3), *small(block_image(modes)), (1, 1), (W.CROSS_COLOUR, 2), (0, 3), *small([[*f, 255] for f in factors]),
        (1, 1), (W.SUBTRACT_GREEN, 2), (0, 1), (0, 1), (0, 1), *codes()[0], *literals(body),
    ]
    assert decode(fields) == px


def reference(green, far, length, distance_code):
    """Fields of a copy: length and distance as prefix symbols with extra bits."""
    out = []
    for lengths, base, v in ((green, 256, length), (far, 0, distance_code)):
        symbol, extra, add = (int(x[0]) for x in W._prefix(np.array([v])))
        out += [W.canonical(lengths)[base + symbol], (add, extra)]
    return out


def test_near_and_far_references():
    """The first distance codes stand for neighbours; codes above 120 for distances, here far beyond a row."""
    assert W.NEAR[:12] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2)]
    width = 10
    fields, green, far = codes(distance=True)
    px = picture(width, 30, 9)
    body = literals(px, green)
    for length, code, distance in ((7, 1, 10), (3, 2, 1), (12, 3, 11), (5, 4, 9), (20, 5, 20), (90, 120 + 217, 217), (33, 120 + 299, 299), (10, 121, 1)):
        body += reference(green, far, length, code)
        for _ in range(length):
            px.append(px[-distance])
    assert len(px) % width == 0
    assert decode([*head(width, len(px) // width), (0, 1), (0, 1), (0, 1), *fields, *body]) == px


def test_reference_before_the_image_fails():
    fields, green, far = codes(distance=True)
    with pytest.raises(ValueError, match="before the image"):
        decode([*head(4, 1), (0, 1), (0, 1), (0, 1), *fields, *literals([[1, 2, 3, 4]], green), *reference(green, far, 3, 125)])


@pytest.mark.parametrize("bits", [1, 5, 11])
def test_colour_cache(bits):
    fields, green, _ = codes(cache=bits)
    px, body, store = [], [], {}
    rng = random.Random(bits)
    pool = picture(30, 1, bits)
    for _ in range(200):
        x = rng.choice(pool)
        argb = x[3] << 24 | x[2] << 16 | x[1] << 8 | x[0]
        key = (argb * 0x1E35A7BD) % 2**32 >> (32 - bits)
        body += [W.canonical(green)[280 + key]] if store.get(key) == argb else literals([x], green)
        store[key] = argb
        px.append(x)
    assert decode([*head(20, 10), (0, 1), (1, 1), (bits, 4), (0, 1), *fields, *body]) == px


def test_entropy_image():
    """Two groups of codes, one of them with simple codes of two and of one symbol, by blocks of four by four."""
    width, height = 8, 4
    px = [[x[0], (7, 200)[x[1] & 1], 9, 255] if i % width >= 4 else x for i, x in enumerate(picture(width, height, 11))]
    two = [(1, 1), (1, 1), (1, 1), (7, 8), (200, 8)]
    group = [*two, (1, 1), (0, 1), (1, 1), (9, 8), *W._code_bits(FLAT), (1, 1), (0, 1), (1, 1), (255, 8), *ONE]
    flat = W.canonical(FLAT)
    body = [f for i, x in enumerate(px) for f in ([(int(x[1] == 200), 1), flat[x[0]]] if i % width >= 4 else literals([x]))]
    assert decode([*head(width, height), (0, 1), (0, 1), (1, 1), (0, 3), *small([[0, 0, 0, 255], [0, 1, 0, 255]]), *codes()[0], *group, *body]) == px


def test_code_lengths_by_repeats():
    """A normal code whose description repeats lengths and runs of zeros."""
    lengths = [0] * 280
    for i in range(100, 116):
        lengths[i] = 4
    px = [[1, 100 + i, 2, 3] for i in range(16)]
    assert decode([*head(16, 1), (0, 1), (0, 1), (0, 1), *W._code_bits(lengths), *(W._code_bits(FLAT) * 3), *ONE, *literals(px, lengths)]) == px


def kinds(file):
    """The transforms of a file of ours."""
    return [t[0] for t in W.read_header(file, 20).transforms]


def test_encoder_chooses_by_content():
    rng = random.Random(12)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)).encode()
    rows = bytes((i // 64 * 3 + i % 64) % 256 for i in range(64 * 120))
    steps = bytes(i // 4 % 256 for i in range(64 * 100))
    cases = {
        "text": (text, []), "rows": (rows, [W.PREDICTOR]), "steps": (steps, [W.PREDICTOR]), "dots": (b".... ,,,," * 200, [W.PALETTE]),
        "two": (b"abcdefgh" * 100, [W.PALETTE])
    }
    sizes = [-(-len(b) // 64) * 64 for b, _ in cases.values()]
    data = b"".join(b + b"\0" * (n - len(b)) for (b, _), n in zip(cases.values(), sizes, strict=True))
    files = W.encode_images(np.frombuffer(data, np.uint8), np.array(sizes))
    at = 0
    for (name, (_, expected)), n, f, [image] in zip(cases.items(), sizes, files, W.decode_batch(files), strict=True):
        assert kinds(f) == expected, name
        assert image.tobytes() == data[at : at + n] and image.shape == (n // 64, 16, 4)
        at += n


def test_one_file_a_text_up_to_the_height():
    for n in (64, W.MOST_BYTES, W.MOST_BYTES + 64):
        data = np.frombuffer(random.Random(n).randbytes(4096) * (n // 4096 + 1), np.uint8)[:n]
        [media] = W.encode_payloads(data, np.array([n]))
        assert len(W.files_in(media)) == (1 if n <= W.MOST_BYTES else 2)
        assert b"".join(x.tobytes() for x in W.decode_batch([media])[0]) == data.tobytes()
