"""The decoder against streams that use every feature of the format."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sonolith.llm import webp


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=2000) | st.text(max_size=800).map(str.encode) | st.lists(st.sampled_from([b"a", b"b"]), max_size=300).map(b"".join))
def test_payload_round_trip(data):
    media = webp.encode(data)
    got = webp.read_payload(media)
    assert got == webp.payload(data) and len(got) % 64 == 0 and len(got) > 0
    assert webp.encode(data) == media


def test_large_payload_is_several_images():
    data = bytes(range(251)) * 5000
    media = webp.encode(data)
    assert len(list(webp.files(media))) == 2 and webp.read_payload(media) == webp.payload(data)


def test_damaged():
    media = webp.encode(b"hello world" * 50)
    for bad in (media[:30], media[:-40], b"RIFF" + media, b"x" * 40):
        with pytest.raises((ValueError, IndexError)):
            webp.read_payload(bad)


def image(h, w, seed=0):
    rng = np.random.default_rng(seed)
    base = np.add.outer(np.arange(h) * 3, np.arange(w) * 5)
    return np.stack([255 - base % 7, base % 256, (base * 2 + rng.integers(0, 3, (h, w))) % 256, base % 13], -1).astype(np.int64)  # A R G B


class Stream:
    """Writes a lossless stream by hand."""

    def __init__(self, h, w):
        self.out = webp.Writer()
        for value, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (0, 4)):
            self.out.put(value, n)

    def pixels(self, argb, main, groups=None, cache=0, back=()):
        """argb: (n, 4). groups: (block, width, group of each block). back: (at, length, code)."""
        out = self.out
        out.put(1 if cache else 0, 1)
        if cache:
            out.put(cache, 4)
        tokens, at, slots, jumps = [], 0, {}, {b[0]: b[1:] for b in back}
        packed = webp._pack(argb).tolist()
        block, width, of = groups or (0, 0, [0])
        across = -(-width // (1 << block)) if groups else 0
        group = (lambda k: of[(k // width >> block) * across + (k % width >> block)]) if groups else (lambda k: 0)
        if main:
            out.put(1 if groups else 0, 1)
            if groups:
                out.put(block - 2, 3)
                self.pixels(np.array([[0, g >> 8, g & 255, 0] for g in of]), False)
        while at < len(packed):
            slot = (webp.CACHE_FACTOR * packed[at] & 0xFFFFFFFF) >> (32 - cache) if cache else None
            if at in jumps:
                n, code = jumps[at]
                tokens.append((group(at), "back", n, code))
            elif cache and slots.get(slot) == packed[at]:
                n = 1
                tokens.append((group(at), "cache", slot, 0))
            else:
                n = 1
                tokens.append((group(at), "pixel", argb[at].tolist(), 0))
            for k in range(at, at + n):
                if cache:
                    slots[(webp.CACHE_FACTOR * packed[k] & 0xFFFFFFFF) >> (32 - cache)] = packed[k]
            at += n

        def prefix(value):
            for s in range(40):
                extra = 0 if s < 4 else (s - 2) >> 1
                low = s + 1 if s < 4 else ((2 + (s & 1)) << extra) + 1
                if low <= value < low + (1 << extra):
                    return s, value - low, extra

        sizes = (280 + ((1 << cache) if cache else 0), 256, 256, 256, 40)
        counts = {g: [np.zeros(n, np.int64) for n in sizes] for g in range(max(of) + 1)}
        for g, kind, x, code in tokens:
            c = counts[g]
            if kind == "pixel":
                for k, v in zip((3, 1, 0, 2), x, strict=True):
                    c[k][v] += 1
            elif kind == "cache":
                c[0][280 + x] += 1
            else:
                c[0][256 + prefix(x)[0]] += 1
                c[4][prefix(code)[0]] += 1
        lengths = {g: [webp.code_lengths(x) for x in c] for g, c in counts.items()}
        codes = {g: [webp.canonical(x) for x in c] for g, c in lengths.items()}
        for g in sorted(lengths):
            for own in lengths[g]:
                webp.write_code(out, own)

        def put(g, k, s):
            if np.count_nonzero(lengths[g][k]) > 1:
                out.put(int(codes[g][k][s]), int(lengths[g][k][s]))

        for g, kind, x, code in tokens:
            if kind == "pixel":
                put(g, 0, x[2])
                put(g, 1, x[1])
                put(g, 2, x[3])
                put(g, 3, x[0])
            elif kind == "cache":
                put(g, 0, 280 + x)
            else:
                s, extra, n = prefix(x)
                put(g, 0, 256 + s)
                out.put(extra, n)
                s, extra, n = prefix(code)
                put(g, 4, s)
                out.put(extra, n)

    def file(self):
        return webp.file_of(self.out.value.to_bytes(self.out.n // 8 + 2, "little"))


def decoded(stream):
    return webp.decode(stream.file())[0][..., [3, 0, 1, 2]].astype(np.int64)


def test_four_channels():
    a = image(9, 20)
    s = Stream(9, 20)
    s.out.put(0, 1)
    s.pixels(a.reshape(-1, 4), True)
    assert (decoded(s) == a).all()


def test_groups_cache_and_back_references():
    a = image(12, 18, 1)
    a[6:9] = a[3:6]  # three rows repeat: distance 3 rows is code 13, (0, 3)
    a[10, 5:15] = a[10, 4]  # runs: distance 1 is code 2, (1, 0)
    s = Stream(12, 18)
    s.out.put(0, 1)
    code = webp.NEAR.index((0, 3)) + 1
    far = 120 + 54  # the same distance without the map
    s.pixels(a.reshape(-1, 4), True, (2, 18, [k % 3 for k in range(15)]), 4, [(6 * 18, 20, code), (6 * 18 + 20, 34, far), (10 * 18 + 5, 10, 2)])
    assert (decoded(s) == a).all()


@pytest.mark.parametrize("mode", range(16))
def test_predictor(mode):
    h, w, block = 9, 14, 2
    a = image(h, w, 2)
    residual = np.zeros_like(a)
    for y in range(h):
        for x in range(w):
            if not x and not y:
                p = [255, 0, 0, 0]
            elif not y:
                p = a[y, x - 1]
            elif not x:
                p = a[y - 1, 0]
            else:
                left, top, tl = a[y, x - 1].tolist(), a[y - 1, x].tolist(), a[y - 1, x - 1].tolist()
                tr = (a[y - 1, x + 1] if x + 1 < w else a[y, 0]).tolist()
                half = lambda p, q: [(i + j) // 2 for i, j in zip(p, q, strict=True)]
                if mode == 11:
                    guess = [i + j - k for i, j, k in zip(left, top, tl, strict=True)]
                    near = lambda q: sum(abs(i - j) for i, j in zip(guess, q, strict=True))
                    p = left if near(left) < near(top) else top
                elif mode == 12:
                    p = [min(255, max(0, i + j - k)) for i, j, k in zip(left, top, tl, strict=True)]
                elif mode == 13:
                    p = [min(255, max(0, m + int((m - k) / 2))) for m, k in zip(half(left, top), tl, strict=True)]
                else:
                    p = [[255, 0, 0, 0], left, top, tr, tl, half(half(left, tr), top), half(left, tl), half(left, top), half(tl, top), half(top, tr), half(half(left, tl), half(top, tr))][mode] if mode < 11 else [255, 0, 0, 0]
            residual[y, x] = (a[y, x] - np.array(p)) & 255
    s = Stream(h, w)
    s.out.put(1, 1)
    s.out.put(webp.PREDICTOR, 2)
    s.out.put(block - 2, 3)
    s.pixels(np.array([[255, 0, mode, 0]] * (-(-h // 4) * -(-w // 4))), False)
    s.out.put(0, 1)
    s.pixels(residual.reshape(-1, 4), True)
    assert (decoded(s) == a).all()


def test_cross_colour_and_subtract_green():
    h, w = 6, 10
    a = image(h, w, 3)
    signed = lambda v: (v + 128) % 256 - 128
    t = {"gr": 37, "gb": 200, "rb": 130}  # green to red, green to blue, red to blue, as bytes
    b = a.copy()
    b[..., 1] = (a[..., 1] - (signed(t["gr"]) * signed(a[..., 2]) >> 5)) & 255
    b[..., 3] = (a[..., 3] - (signed(t["gb"]) * signed(a[..., 2]) >> 5) - (signed(t["rb"]) * signed(a[..., 1]) >> 5)) & 255
    g = b.copy()
    g[..., 1] = (b[..., 1] - b[..., 2]) & 255
    g[..., 3] = (b[..., 3] - b[..., 2]) & 255
    s = Stream(h, w)
    s.out.put(1, 1)
    s.out.put(webp.CROSS_COLOUR, 2)
    s.out.put(0, 3)
    s.pixels(np.array([[255, t["rb"], t["gb"], t["gr"]]] * 6), False)
    s.out.put(1, 1)
    s.out.put(webp.SUBTRACT_GREEN, 2)
    s.out.put(0, 1)
    s.pixels(g.reshape(-1, 4), True)
    assert (decoded(s) == a).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palette(colours):
    rng = np.random.default_rng(colours)
    table = rng.integers(0, 256, (colours, 4))
    h, w = 7, 19
    index = rng.integers(0, colours, (h, w))
    s = Stream(h, w)
    s.out.put(1, 1)
    s.out.put(webp.PALETTE, 2)
    s.out.put(colours - 1, 8)
    s.pixels(np.diff(table, axis=0, prepend=0) & 255, False)
    s.out.put(0, 1)
    n = webp.bundle_bits(colours)
    per = 1 << n
    padded = np.pad(index, ((0, 0), (0, -w % per))).reshape(h, -1, per)
    green = (padded << (np.arange(per) * (8 >> n))).sum(-1).ravel()
    s.pixels(np.stack([np.full(len(green), 255), 0 * green, green, 0 * green], -1), True)
    assert (decoded(s) == table[index]).all()
