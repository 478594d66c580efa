"""Media columns in the lossless WebP format: encoder, complete decoder, features.

The decoder follows the public bitstream specification: prefix codes (simple and
normal), groups by an entropy image, back-references, colour cache, and the inverse
predictor, cross-colour, subtract-green and palette transforms; it writes pixel
arrays. Where only one channel varies, code lengths are looked up for all bit
positions at once and the literals of a run are read side by side.

Every payload of more than 16 values is stored four samples a pixel, 16 pixels a row,
with the predictor and the cross-colour factors of each tile that leave the smallest
residuals, a colour cache where it saves bits, and back-references; one of 16 values at
most goes through a palette, whose pixels share bytes, with back-references. A third
layout, a sample a pixel, is there on demand. Payloads of a batch are encoded and
decoded side by side: arrays hold a place of each, so that a step serves all of them.
Payloads over 2^20 bytes go into several images, one file after another.

Defined results: null text is empty, and an empty payload is 64 zero bytes; equal
texts give equal bytes; damaged files raise ValueError; other columns are kept.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonolith.llm.common import bounded_batches

WIDTH, ROWS = 64, 1 << 14
#: Pixels a row of four samples each, and the power of 2 of a tile's side.
COLOUR_WIDTH, TILE = WIDTH // 4, 3
BLACK = np.array([0, 0, 0, 255], np.uint8)
#: Images of fewer pixels are read one by one.
ONE_BY_ONE = 256
#: Payload bytes, and images, that are worked on side by side at most.
TOGETHER, IMAGES = 1 << 22, 1 << 11
DIGESTS = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, paths string"
#: Fixed values of the format.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
TRANSFORMS = ("predictor", "cross-colour", "subtract-green", "palette")
CACHE_FACTOR = 0x1E35A7BD
#: Fixed values of the format: (x, y) of the short distance codes 1 to 120.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


class Bits:
    """Reads bits, lowest first. paths: the parts of the format met so far."""

    def __init__(self, data: bytes, paths: set[str] | None = None):
        self.size, self.data, self.at = 8 * len(data), data + bytes(16), 0
        self.paths = set() if paths is None else paths

    def peek(self, n: int) -> int:
        first = self.at >> 3
        return int.from_bytes(self.data[first : first + 5], "little") >> (self.at & 7) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        if not n:
            return 0
        if self.at + n > self.size:
            raise ValueError("the stream ends early")
        got = self.peek(n)
        self.at += n
        return got


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def text(self) -> str:
        return _text(self.value, self.n)


_REVERSED = np.zeros(1 << 15, np.int64)
for _k in range(15):
    _REVERSED |= (np.arange(1 << 15) >> _k & 1) << (14 - _k)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of the symbols, with their bits in reading order."""
    codes = np.zeros(len(lengths), np.int64)
    used = lengths.nonzero()[0]
    if len(used) == 0:
        return codes
    used = used[lengths[used].argsort(kind="stable")]
    # In order, each code is the one before plus 1, at its own length.
    width = 1 << (15 - lengths[used].astype(np.int64))
    codes[used] = _REVERSED[width.cumsum() - width]
    return codes


@lru_cache(16)
def _mirrored(bits: int) -> np.ndarray:
    """All numbers of so many bits, each with its bits reversed."""
    return _REVERSED[: 1 << bits] >> (15 - bits)


class Code:
    """A prefix code as a table over the next `bits` bits: symbol times 16, and length."""

    lists = None

    def __init__(self, lengths: np.ndarray | None = None, packed: np.ndarray | None = None, bits: int = 0):
        if packed is not None:
            self.packed, self.bits = packed, bits
            return
        used = lengths.nonzero()[0]
        if len(used) < 2:
            self.bits, self.packed = 0, np.array([used[0] << 4 if len(used) else 0], np.uint16)
            return
        own = lengths[used]
        order = own.argsort(kind="stable")
        used, n = used[order], own[order]
        self.bits = bits = int(n[-1])
        room = np.int64(1) << (bits - n)
        if int(room.sum()) != 1 << bits:
            raise ValueError("a prefix code isn't complete")
        self.packed = (used << 4 | n).astype(np.uint16).repeat(room).take(_mirrored(bits))

    @property
    def symbol(self) -> np.ndarray:
        return self.packed.astype(np.int64) >> 4

    @property
    def length(self) -> np.ndarray:
        return (self.packed & np.uint16(15)).astype(np.uint8)

    def tables(self) -> tuple[list[int], list[int], int]:
        """Symbols, lengths and the mask of a reader that goes symbol by symbol."""
        if self.lists is None:
            self.lists = self.symbol.tolist(), self.length.tolist(), (1 << self.bits) - 1
        return self.lists

    def read(self, bits: Bits) -> int:
        if not self.bits:
            return int(self.packed[0]) >> 4
        symbols, lengths, mask = self.tables()
        w = bits.peek(self.bits)
        bits.at += lengths[w]
        return symbols[w]


@lru_cache(4096)
def _simple(symbols: tuple[int, ...]) -> Code:
    lengths = np.zeros(256, np.int64)
    lengths[list(symbols)] = 1
    return Code(lengths)


@lru_cache(1024)
def _small(lengths: tuple[int, ...]) -> Code:
    return Code(np.array(lengths, np.int64))


def read_code(bits: Bits, alphabet: int) -> Code:
    w, at = bits.peek(32), bits.at
    if w & 1:
        wide = 8 if w & 4 else 1
        symbols = [w >> 3 & (1 << wide) - 1]
        bits.at = at + 3 + wide
        if w & 2:
            symbols.append(w >> 3 + wide & 255)
            bits.at += 8
        if max(symbols) >= alphabet:
            raise ValueError("a symbol is outside its alphabet")
        return _simple(tuple(symbols))
    bits.at = at + 5
    own = [0] * 19
    for k in range(4 + (w >> 1 & 15)):
        own[LENGTH_ORDER[k]] = bits.peek(3)
        bits.at += 3
    table = _small(tuple(own))
    symbols, widths, mask = table.tables()
    left = alphabet if not bits.read(1) else 2 + bits.read(2 + 2 * bits.read(3))
    lengths, last, data, at = [], 8, bits.data, bits.at
    while len(lengths) < alphabet and left:
        left -= 1
        w = int.from_bytes(data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        s = symbols[w & mask]
        at += widths[w & mask]
        if s < 16:
            lengths.append(s)
            last = s or last
            continue
        w >>= widths[w & mask]
        if s == 16:
            lengths += [last] * (3 + (w & 3))
            at += 2
        elif s == 17:
            lengths += [0] * (3 + (w & 7))
            at += 3
        else:
            lengths += [0] * (11 + (w & 127))
            at += 7
    bits.at = at
    if len(lengths) > alphabet:
        raise ValueError("code lengths run over")
    if at > bits.size:
        raise ValueError("the stream ends early")
    return Code(np.array(lengths + [0] * (alphabet - len(lengths)), np.int64))


def _distance(code: int, width: int) -> int:
    return max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width) if code <= 120 else code - 120


def _one_channel(bits: Bits, codes: list[Code], width: int, total: int) -> np.ndarray:
    """Pixels whose red, blue and alpha are fixed: literals, eight at a time, and back-references."""
    green, distance = codes[0], codes[4]
    fixed = np.uint32(sum(int(c.symbol[0]) << shift for c, shift in zip(codes[1:4], (16, 0, 24), strict=True)))
    if not green.bits and green.symbol[0] < 256:
        return np.full(total, int(green.symbol[0]) << 8 | int(fixed), np.uint32)
    first, at = bits.at & ~7, bits.at & 7
    data = np.frombuffer(bits.data, np.uint8, offset=first >> 3).astype(np.int64)
    window = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    window = (window[:, None] >> np.arange(8) & (1 << green.bits) - 1).ravel()
    # Per bit position: a literal that begins there and its length, 0 for anything else.
    step = np.where(green.symbol < 256, green.length, 0).astype(np.uint8).take(window)
    value = green.symbol.astype(np.uint8).take(window)
    # Two, four, eight literals from each position: their lengths, 0 where something else comes first.
    place, eight = np.arange(len(step)), step
    for _ in range(3):
        onward = eight.take(place + eight, mode="clip")
        eight = (eight + onward) * (onward != 0)
    ones, eights, held = step.tobytes(), eight.tobytes(), bits.data
    far, far_mask = (distance.symbol.tolist(), distance.length.tolist()), (1 << distance.bits) - 1
    begins, puts, single, put, jumps, done = [], [], [], [], [], 0
    while done < total:
        here = done
        for _ in range(total - done >> 3):
            d = eights[at]
            if not d:
                break
            begins.append(at)
            puts.append(done)
            at += d
            done += 8
        for _ in range(min(8, total - done)):
            d = ones[at]
            if not d:
                break
            single.append(at)
            put.append(done)
            at += d
            done += 1
        if done > here:
            continue
        if first + at >= bits.size:
            raise ValueError("the stream ends early")
        w = int.from_bytes(held[(first + at) >> 3 : ((first + at) >> 3) + 9], "little") >> (at & 7)
        s, used = int(green.symbol[window[at]]) - 256, int(green.length[window[at]])
        if s < 0:
            raise ValueError("the stream ends early")
        extra = (s - 2) >> 1 if s > 3 else 0
        n = ((2 + (s & 1)) << extra) + (w >> used & (1 << extra) - 1) + 1 if extra else s + 1
        w >>= used + extra
        s, also = far[0][w & far_mask], far[1][w & far_mask]
        more = (s - 2) >> 1 if s > 3 else 0
        d = _distance(((2 + (s & 1)) << more) + (w >> also & (1 << more) - 1) + 1 if more else s + 1, width)
        if d > done or done + n > total:
            raise ValueError("a back-reference leaves the image")
        jumps.append((done, n, d))
        at += used + extra + also + more
        done += n
    bits.at = first + at
    if bits.at > bits.size:
        raise ValueError("the stream ends early")
    out = np.zeros(total, np.uint8)
    if begins:
        at, to = np.array(begins), np.array(puts)
        for k in range(8):
            out[to + k] = value[at]
            at = at + step[at]
    if single:
        out[np.array(put)] = value[np.array(single)]
    if jumps:
        bits.paths.add("back-references")
        copied = bytearray(out.tobytes())
        for at, n, d in jumps:
            copied[at : at + n] = copied[at - d : at - d + n] if d >= n else (copied[at - d : at] * (n // d + 1))[:n]
        out = np.frombuffer(bytes(copied), np.uint8)
    return out.astype(np.uint32) << np.uint32(8) | fixed


def _prefixed(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


@dataclass
class Head:
    """What stands before the pixels of an entropy-coded image."""

    cache_bits: int
    block: int
    across: int
    entropy: list[int] | None
    codes: list[list[Code]]

    def one_channel(self) -> bool:
        return len(self.codes) == 1 and not self.cache_bits and not any(c.bits for c in self.codes[0][1:4])

    def alike(self, total: int) -> bool:
        """Whether so many pixels can be read side by side with others': one group, and a pixel in 57 bits."""
        return len(self.codes) == 1 and (total < ONE_BY_ONE or not self.one_channel()) and sum(c.bits for c in self.codes[0][:4]) <= 57


def _head_of(bits: Bits, width: int, height: int, main: bool) -> Iterator[tuple]:
    """Reads a head; asks for codes by the stream and their alphabets."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    groups, block, entropy, across = 1, 0, None, 0
    if main and bits.read(1):
        bits.paths.add("groups")
        block = 2 + bits.read(3)
        across = (width + (1 << block) - 1) >> block
        entropy = ((yield from _pixels_of(bits, across, (height + (1 << block) - 1) >> block)) >> np.uint32(8) & np.uint32(0xFFFF)).tolist()
        groups = max(entropy) + 1
    cache_size = 1 << cache_bits if cache_bits else 0
    codes = []
    for _ in range(groups):
        codes.append((yield bits, [256 + 24 + cache_size, 256, 256, 256, 40]))
    return Head(cache_bits, block, across, entropy, codes)


def _pixels_of(bits: Bits, width: int, height: int) -> Iterator[tuple]:
    """Entropy-coded ARGB pixels of a transform's image."""
    return (yield bits, width, height, (yield from _head_of(bits, width, height, False)))


def read_body(bits: Bits, width: int, height: int, head: Head, out: list[int] | None = None) -> np.ndarray:
    """The pixels behind a head; out: those read so far."""
    cache_bits, block, across, entropy, codes = head.cache_bits, head.block, head.across, head.entropy, head.codes
    total, at = width * height, len(out or ())
    if total >= ONE_BY_ONE and head.one_channel():
        return _one_channel(bits, codes[0], width, total)
    readers = [[c.tables() for c in group] for group in codes]
    out, cache, added = (out or []) + [0] * (total - at), [0] * (1 << cache_bits), 0
    data, pos, end = bits.data, bits.at, bits.size + 64
    (green, g_len, g_mask), (red, r_len, r_mask), (blue, b_len, b_mask), (alpha, a_len, a_mask), _ = readers[0]
    while at < total:
        if pos > end:
            raise ValueError("the stream ends early")
        x, y = at % width, at // width
        group = entropy[(y >> block) * across + (x >> block)] if entropy else 0
        if entropy:
            (green, g_len, g_mask), (red, r_len, r_mask), (blue, b_len, b_mask), (alpha, a_len, a_mask), _ = readers[group]
        w = int.from_bytes(data[pos >> 3 : (pos >> 3) + 9], "little") >> (pos & 7)
        s, n = green[w & g_mask], g_len[w & g_mask]
        if s < 256:
            w >>= n
            pos += n
            r, n = red[w & r_mask], r_len[w & r_mask]
            w >>= n
            pos += n
            b, n = blue[w & b_mask], b_len[w & b_mask]
            w >>= n
            pos += n
            out[at] = alpha[w & a_mask] << 24 | r << 16 | s << 8 | b
            pos += a_len[w & a_mask]
            at += 1
        elif s < 280:
            bits.at = pos + n
            bits.paths.add("back-references")
            n = _prefixed(bits, s - 256)
            d = _distance(_prefixed(bits, codes[group][4].read(bits)), width)
            pos = bits.at
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for _ in range(n):
                out[at] = out[at - d]
                at += 1
        else:
            pos += n
            bits.paths.add("cache")
            while added < at:  # the cache is filled only as far as it is read
                cache[(CACHE_FACTOR * out[added] & 0xFFFFFFFF) >> (32 - cache_bits)] = out[added]
                added += 1
            out[at] = cache[s - 280]
            at += 1
    bits.at = pos
    if pos > bits.size:
        raise ValueError("the stream ends early")
    return np.array(out, np.uint32)


def _channels(p: np.ndarray) -> np.ndarray:
    return np.stack([p >> np.uint32(s) & np.uint32(255) for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _pack(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


#: Alternate channels of a packed pixel, which leave room for carries.
_EVEN, _ODD = 0x00FF00FF, 0xFF00FF00


def _mean(a: int, b: int) -> int:
    """Means of two packed pixels, channel by channel."""
    return ((a ^ b) & 0xFEFEFEFE) // 2 + (a & b)


def _each(p: int) -> tuple[int, int, int, int]:
    return p >> 24, p >> 16 & 255, p >> 8 & 255, p & 255


def _joined(channels) -> int:
    a, r, g, b = channels
    return a << 24 | r << 16 | g << 8 | b


def _select(left: int, top: int, top_right: int, top_left: int) -> int:
    corner = _each(top_left)
    down = sum(abs(x - c) for x, c in zip(_each(top), corner, strict=True))
    across = sum(abs(x - c) for x, c in zip(_each(left), corner, strict=True))
    return left if down < across else top


def _full(left: int, top: int, top_right: int, top_left: int) -> int:
    return _joined(min(255, max(0, x + y - c)) for x, y, c in zip(_each(left), _each(top), _each(top_left), strict=True))


def _half(left: int, top: int, top_right: int, top_left: int) -> int:
    return _joined(min(255, max(0, m + int((m - c) / 2))) for m, c in zip(_each(_mean(left, top)), _each(top_left), strict=True))


#: The predicted packed pixel by mode, from its decoded neighbours: left, top, top right, top left.
PREDICTIONS = (
    lambda l, t, r, c: 0xFF000000,
    lambda l, t, r, c: l,
    lambda l, t, r, c: t,
    lambda l, t, r, c: r,
    lambda l, t, r, c: c,
    lambda l, t, r, c: _mean(_mean(l, r), t),
    lambda l, t, r, c: _mean(l, c),
    lambda l, t, r, c: _mean(l, t),
    lambda l, t, r, c: _mean(c, t),
    lambda l, t, r, c: _mean(t, r),
    lambda l, t, r, c: _mean(_mean(l, c), _mean(t, r)),
    _select,
    _full,
    _half,
    lambda l, t, r, c: 0xFF000000,
    lambda l, t, r, c: 0xFF000000,
)


def _undo_predictor(p: np.ndarray, width: int, height: int, block: int, modes: np.ndarray) -> np.ndarray:
    p = p.tolist()
    across = (width + (1 << block) - 1) >> block
    modes = (modes >> np.uint32(8) & np.uint32(15)).tolist()
    p[0] = p[0] + 0xFF000000 & 0xFFFFFFFF
    for at in range(1, len(p)):
        x, y = at % width, at // width
        if not y:
            guess = p[at - 1]
        elif not x:
            guess = p[at - width]
        else:  # right of the last column comes the first pixel of the same row
            guess = PREDICTIONS[modes[(y >> block) * across + (x >> block)]](p[at - 1], p[at - width], p[at - width + 1], p[at - width - 1])
        here = p[at]
        p[at] = (here & _EVEN) + (guess & _EVEN) & _EVEN | (here & _ODD) + (guess & _ODD) & _ODD
    return np.array(p, np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x + 128 & 255) - 128


def _undo_cross_colour(p: np.ndarray, width: int, height: int, block: int, factors: np.ndarray) -> np.ndarray:
    across = (width + (1 << block) - 1) >> block
    at = (np.arange(height)[:, None] >> block) * across + (np.arange(width)[None, :] >> block)
    f, c = _channels(factors)[at.ravel()], _channels(p)
    green = _signed(c[:, 2])
    c[:, 1] = c[:, 1] + (_signed(f[:, 3]) * green >> 5) & 255
    c[:, 3] = c[:, 3] + (_signed(f[:, 2]) * green >> 5) + (_signed(f[:, 1]) * _signed(c[:, 1]) >> 5) & 255
    return _pack(c)


def _undo_subtract_green(p: np.ndarray) -> np.ndarray:
    c = _channels(p)
    c[:, 1] = c[:, 1] + c[:, 2] & 255
    c[:, 3] = c[:, 3] + c[:, 2] & 255
    return _pack(c)


def bundle_bits(colours: int) -> int:
    """2 to this power pixels share one stored pixel."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _undo_palette(p: np.ndarray, width: int, height: int, table: np.ndarray) -> np.ndarray:
    n = bundle_bits(len(table))
    index = (p >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
    if n:
        per, depth = 1 << n, 8 >> n
        index = (index[:, :, None] >> (np.arange(per, dtype=np.uint32) * depth) & np.uint32((1 << depth) - 1)).reshape(height, -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    return full[index].ravel()


@dataclass
class Parsed:
    """A stream up to its main image's pixels. todo: its transforms, as kind, width, tile
    and image; stored: the width of the pixels."""

    bits: Bits
    width: int
    height: int
    stored: int
    todo: list[tuple]
    head: Head


def _parsed(data: bytes, paths: set[str] | None) -> Iterator[tuple]:
    """Reads a stream up to its main image's pixels."""
    if data[:1] != b"\x2f":
        raise ValueError("no lossless bitstream")
    bits = Bits(data[1:], paths)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    todo, stored = [], width
    while bits.read(1):
        kind = bits.read(2)
        bits.paths.add(TRANSFORMS[kind])
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            across = (stored + (1 << block) - 1) >> block
            own = yield from _pixels_of(bits, across, (height + (1 << block) - 1) >> block)
            todo.append((kind, stored, block, own))
        elif kind == PALETTE:
            deltas = _channels((yield from _pixels_of(bits, bits.read(8) + 1, 1)))
            table = _pack(np.cumsum(deltas, 0) & 255)
            todo.append((kind, stored, 0, table))
            n = bundle_bits(len(table))
            stored = (stored + (1 << n) - 1) >> n
        else:
            todo.append((kind, stored, 0, None))
    return Parsed(bits, width, height, stored, todo, (yield from _head_of(bits, stored, height, True)))


def _undone(x: Parsed, p: np.ndarray) -> np.ndarray:
    """Pixels without their stream's transforms."""
    for kind, w, block, own in reversed(x.todo):
        if kind == PREDICTOR:
            p = _undo_predictor(p, w, x.height, block, own)
        elif kind == CROSS_COLOUR:
            p = _undo_cross_colour(p, w, x.height, block, own)
        elif kind == PALETTE:
            p = _undo_palette(p, w, x.height, own)
        else:
            p = _undo_subtract_green(p)
    return p


def decode_stream(data: bytes, paths: set[str] | None = None) -> np.ndarray:
    """ARGB pixels (height, width) of a lossless bitstream. paths takes the names of
    the transforms and codes that the stream uses."""
    return decode_streams([data], [paths])[0]


#: Repeat counts of code length symbols: least, and bits of what is added.
REPEATS = np.array([1] * 16 + [3, 3, 11]), np.array([0] * 16 + [2, 3, 7])


def _packed_tables(row: np.ndarray, symbols: np.ndarray, lengths: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables of many codes, one after another: symbol and length of each run of bits,
    with each table's first place and bits. Entries are the used symbols, by row."""
    n = np.bincount(row, minlength=rows)
    lengths = np.where(n[row] > 1, lengths, 0)
    bits = np.zeros(rows, np.int64)
    np.maximum.at(bits, row, lengths)
    order = (row * 16 + lengths).argsort(kind="stable")
    row, symbols, lengths = row[order], symbols[order], lengths[order]
    room = np.int64(1) << bits[row] - lengths
    size = np.int64(1) << bits
    if (np.bincount(row, room, rows).astype(np.int64) != size)[n > 0].any():
        raise ValueError("a prefix code isn't complete")
    first = size.cumsum() - size
    flat = np.zeros(int(size.sum()), np.uint16)  # a code without symbols reads 0
    flat[np.flatnonzero((n > 0).repeat(size))] = (symbols << 4 | lengths).astype(np.uint16).repeat(room)
    start = first.repeat(size)
    return flat.take(start + (_REVERSED.take(np.arange(len(flat)) - start) >> (15 - bits).repeat(size))), first, bits


def read_codes(asked: list[tuple[Bits, list[int]]]) -> list[list[Code]]:
    """The codes that stand next in each of many streams, over these alphabets, side by side."""
    if len(asked) < FEW_BODIES:
        return [[read_code(bits, a) for a in alphabets] for bits, alphabets in asked]
    streams = [x.data for x, _ in asked]
    first = np.cumsum([0, *map(len, streams)])[:-1] * 8
    held = np.frombuffer(b"".join(streams) + bytes(4096), np.uint8)
    words = np.ndarray((len(held) - 7,), "<i8", held, strides=(1,)).copy()
    last = len(words) - 1
    pos, many = first + np.array([x.at for x, _ in asked]), len(asked)
    end = first + np.array([x.size for x, _ in asked])
    out = [[] for _ in asked]
    for alphabet in np.array([a for _, a in asked]).T:
        w = words.take(pos >> 3) >> (pos & 7)
        lengths = np.zeros((many, int(alphabet.max())), np.uint8)
        simple = np.flatnonzero(w & 1)
        v = w[simple]
        wide = np.where(v & 4, 8, 1)
        one, two = v >> 3 & (1 << wide) - 1, np.where(v & 2, v >> 3 + wide & 255, -1)
        if (np.maximum(one, two) >= alphabet[simple]).any():
            raise ValueError("a symbol is outside its alphabet")
        lengths[simple, one] = 1
        lengths[simple[two >= 0], two[two >= 0]] = 1
        pos[simple] += 3 + wide + np.where(two >= 0, 8, 0)
        who = np.flatnonzero(~w & 1)
        if len(who):
            n = 4 + (w[who] >> 1 & 15)
            at = pos[who][:, None] + 5 + 3 * np.arange(19)
            own = np.zeros((len(who), 19), np.int64)
            own[:, LENGTH_ORDER] = np.where(np.arange(19) < n[:, None], words.take(at >> 3) >> (at & 7) & 7, 0)
            r, s = own.nonzero()
            table, base, bits = _packed_tables(r, s, own[r, s], len(who))
            mask = (1 << bits) - 1
            p = pos[who] + 5 + 3 * n
            w = words.take(p >> 3) >> (p & 7)
            short = (w & 1) > 0
            extra = 2 + 2 * (w >> 1 & 7)
            left = np.where(short, 2 + (w >> 4 & (1 << extra) - 1), alphabet[who])
            p += np.where(short, 4 + extra, 1)
            done, before, total = np.zeros(len(who), np.int64), np.full(len(who), 8), alphabet[who]
            while len(who):
                w = words.take(np.minimum(p >> 3, last)) >> (p & 7)
                e = table.take(base + (w & mask)).astype(np.int64)
                s, used = e >> 4, e & 15
                more = REPEATS[1].take(s)
                n = REPEATS[0].take(s) + (w >> used & (1 << more) - 1)
                value = np.where(s < 16, s, 0)
                lengths[who, np.minimum(done, total - 1)] = value
                again = np.flatnonzero(s == 16)
                for i in again.tolist():
                    lengths[who[i], done[i] : done[i] + n[i]] = before[i]
                before = np.where(value > 0, value, before)
                done, left, p = done + n, left - 1, p + used + more
                live = (done < total) & (left > 0)
                if not live.all():
                    if (done > total).any():
                        raise ValueError("code lengths run over")
                    pos[who] = p
                    who, p, base, mask, left, done, before, total = (x[live] for x in (who, p, base, mask, left, done, before, total))
        if (pos > end).any():
            raise ValueError("the stream ends early")
        r, s = lengths.nonzero()
        table, base, bits = _packed_tables(r, s, lengths[r, s].astype(np.int64), many)
        for k, (a, b) in enumerate(zip(base.tolist(), bits.tolist(), strict=True)):
            out[k].append(Code(packed=table[a : a + (1 << b)], bits=b))
    for (bits, _), at in zip(asked, (pos - first).tolist(), strict=True):
        bits.at = at
    return out


def _side_by_side(readers: list[Iterator]) -> list:
    """Results of generators that ask for codes or pixels: what all ask for is read together."""
    out, asked = [None] * len(readers), {}

    def on(k, got):
        try:
            asked[k] = readers[k].send(got)
        except StopIteration as e:
            out[k] = e.value

    for k in range(len(readers)):
        on(k, None)
    while asked:
        now = dict(asked)
        asked.clear()
        for read, parts in ((read_codes, 2), (read_bodies, 4)):
            own = [k for k, x in now.items() if len(x) == parts]
            for k, got in zip(own, read([now[k] for k in own]), strict=True):
                on(k, got)
    return out


#: Fewer images than this go pixel by pixel, not side by side.
FEW_BODIES, FEW_TALL = 24, 5


def _cached_ones(wide: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which images have a colour cache, with its first place and the shift to its slots."""
    k = np.flatnonzero(wide[1] < 32)
    return k, wide[0][k], wide[1][k]


def read_bodies(images: list[tuple]) -> list[np.ndarray]:
    """read_body of each (bits, width, height, head), side by side where they have one group."""
    side = [k for k, x in enumerate(images) if x[3].alike(x[1] * x[2])]
    if len(side) < FEW_BODIES:
        return [read_body(*x) for x in images]
    found = dict(zip(side, _bodies([images[k] for k in side]), strict=True))
    return [found[k] if k in found else read_body(*x) for k, x in enumerate(images)]


def _bodies(images: list[tuple]) -> list[np.ndarray]:
    """Pixels of images (bits, width, height, head) of one group, a pixel of each at a
    time; the last few go on alone."""
    out = [None] * len(images)
    size = [w * h for _, w, h, _ in images]
    starts = np.cumsum([0, *size])
    pixels = np.zeros(int(starts[-1]), np.int64)
    streams = [x[0].data for x in images]
    first = np.cumsum([0, *map(len, streams)])
    held = np.frombuffer(b"".join(streams) + bytes(1024), np.uint8)
    words = np.ndarray((len(held) - 7,), "<i8", held, strides=(1,)).copy()
    # Tables: a symbol at its channel's place, times 16, and its length.
    tables, masks, bases, at = [], [], [], 0
    for c, shift in enumerate((8, 16, 0, 24)):
        own = [x[3].codes[0][c].packed for x in images]
        packed, n = np.concatenate(own).astype(np.int64), np.array(list(map(len, own)))
        tables.append(packed >> 4 << shift + 4 | packed & 15)
        masks.append(n - 1)
        bases.append(at + n.cumsum() - n)
        at += len(packed)
    table, masks, bases = np.concatenate(tables), np.array(masks), np.array(bases)
    cache_bits = np.array([x[3].cache_bits for x in images])
    cache_first = np.where(cache_bits > 0, 1 << cache_bits, 0).cumsum() - np.where(cache_bits > 0, 1 << cache_bits, 0)
    cache, cached = np.zeros(int((1 << cache_bits).sum()) + 1, np.int64), bool(cache_bits.any())
    who, pos, to = np.arange(len(images)), np.array([x[0].at for x in images]) + 8 * first[:-1], starts[:-1].copy()
    limit, end = np.array([x[0].size + 64 for x in images]) + 8 * first[:-1], starts[1:]
    own, wide, count = (bases, masks), (cache_first, 32 - cache_bits), 0
    special, sure, with_cache = 256 << 12, int((end - to).min()), _cached_ones(wide)
    while len(who) >= FEW_BODIES:
        w = words.take(pos >> 3) >> (pos & 7)
        got = green = table.take(own[0][0] + (w & own[1][0]))
        used = green & 15
        for c in (1, 2, 3):
            part = table.take(own[0][c] + (w >> used & own[1][c]))
            used = used + (part & 15)
            got = got | part
        got = got >> 4
        odd = np.flatnonzero(green >= special) if green.max() >= special else ()
        if len(odd):
            symbol, n = green[odd] >> 12, green[odd] & 15
            used[odd] = n
            if cached:
                hits = symbol >= 280
                got[odd[hits]] = cache[wide[0][odd[hits]] + symbol[hits] - 280]
                for k in who[odd[hits]].tolist():
                    images[k][0].paths.add("cache")
            for i in odd[symbol < 280].tolist():
                k, here = int(who[i]), int(to[i])
                bits, width, _, head = images[k]
                bits.at = int(pos[i]) - 8 * int(first[k]) + int(green[i] & 15)
                bits.paths.add("back-references")
                n = _prefixed(bits, int(green[i] >> 12) - 256)
                d = _distance(_prefixed(bits, head.codes[0][4].read(bits)), width)
                if d > here - starts[k] or here + n > end[i]:
                    raise ValueError("a back-reference leaves the image")
                pixels[here : here + n] = np.resize(pixels[here - d : here - d + min(n, d)], n)
                if cached and head.cache_bits:
                    p = pixels[here : here + n]
                    for slot, value in zip(((p * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - head.cache_bits)).tolist(), p.tolist(), strict=True):
                        cache[wide[0][i] + slot] = value
                # The last pixel copied is written once more below.
                got[i], to[i] = pixels[here + n - 1], here + n - 1
                used[i] = bits.at + 8 * int(first[k]) - pos[i]
        pixels[to] = got
        if cached:
            p = got[with_cache[0]]
            cache[with_cache[1] + ((p * CACHE_FACTOR & 0xFFFFFFFF) >> with_cache[2])] = p
        pos, to, count, sure = pos + used, to + 1, count + 1, sure - 1
        if not count & 15 and (pos > limit).any():
            raise ValueError("the stream ends early")
        if len(odd):
            sure = int((end - to).min())
        if sure > 0:
            continue
        left = to < end
        if not left.all():
            for k, at in zip(who[~left].tolist(), pos[~left].tolist(), strict=True):
                images[k][0].at = at - 8 * int(first[k])
                if images[k][0].at > images[k][0].size:
                    raise ValueError("the stream ends early")
                out[k] = pixels[starts[k] : starts[k + 1]].astype(np.uint32)
            who, pos, to, limit, end = who[left], pos[left], to[left], limit[left], end[left]
            own, wide = (own[0][:, left], own[1][:, left]), (wide[0][left], wide[1][left])
            with_cache = _cached_ones(wide)
        sure = int((end - to).min()) if len(to) else 0
    for k, at, here in zip(who.tolist(), pos.tolist(), to.tolist(), strict=True):
        images[k][0].at = at - 8 * int(first[k])
        out[k] = read_body(*images[k], pixels[starts[k] : here].tolist())
    return out


def _wave_guess(p: np.ndarray, at: np.ndarray, mode: int, width: int) -> np.ndarray:
    """What a mode predicts for packed pixels at these places, whose neighbours are decoded."""

    def mean(a, b):
        return ((a ^ b) & np.uint32(0xFEFEFEFE)) // np.uint32(2) + (a & b)

    def wide(x):
        return x.view(np.uint8).reshape(-1, 4).astype(np.int16)

    def packed(x):
        return np.clip(x, 0, 255).astype(np.uint8).view(np.uint32).ravel()

    left, top, right, corner = (lambda k=k: p[at - k] for k in (1, width, width - 1, width + 1))
    if mode in (1, 2, 3, 4):
        return (left, top, right, corner)[mode - 1]()
    if mode == 5:
        return mean(mean(left(), right()), top())
    if mode in (6, 7, 8, 9):
        a, b = ((left, corner), (left, top), (corner, top), (top, right))[mode - 6]
        return mean(a(), b())
    if mode == 10:
        return mean(mean(left(), corner()), mean(top(), right()))
    if mode == 11:
        a, b, c = left(), top(), corner()
        down, along = (np.abs(wide(x) - wide(c)) for x in (b, a))
        return np.where(down[:, 0] + down[:, 1] + down[:, 2] + down[:, 3] < along[:, 0] + along[:, 1] + along[:, 2] + along[:, 3], a, b)
    if mode == 12:
        return packed(wide(left()) + wide(top()) - wide(corner()))
    if mode == 13:
        middle = wide(mean(left(), top()))
        rest = middle - wide(corner())
        return packed(middle + (rest + (rest < 0) >> 1))
    return np.full(len(at), 0xFF000000, np.uint32)


def _undo_stack(images: list[np.ndarray], heights: list[int], width: int, block: int, modes: list[np.ndarray], factors: list[np.ndarray] | None) -> list[np.ndarray]:
    """Images of one width without cross-colour and predictor, wave by wave: pixels with
    equal x + 2 y need none of each other, whatever image they are of."""
    h = np.array(heights)
    n, across = h * width, (width + (1 << block) - 1) >> block
    first, tile_n = n.cumsum() - n, np.array([len(x) for x in modes])
    inner = np.arange(n.sum(), dtype=np.int32) - first.astype(np.int32).repeat(n)
    y = inner // np.int32(width)
    x = inner - y * np.int32(width)
    tile = (y >> block) * across + (x >> block) + (tile_n.cumsum() - tile_n).astype(np.int32).repeat(n)
    p = np.concatenate(images)
    if factors is not None:
        c, f = p.view(np.uint8).reshape(-1, 4), np.concatenate(factors).view(np.int8).reshape(-1, 4).astype(np.int16)
        to_red, to_blue, also = (f[:, k][tile] for k in range(3))
        green = np.ascontiguousarray(c[:, 1]).view(np.int8)
        red = (c[:, 2] + (to_red * green >> 5)).astype(np.uint8)
        c[:, 0] = (c[:, 0] + (to_blue * green >> 5) + (also * red.view(np.int8) >> 5)).astype(np.uint8)
        c[:, 2] = red
    mode = (np.concatenate(modes) >> np.uint32(8) & np.uint32(15)).astype(np.int32)[tile]
    mode[y == 0] = 1
    mode[x == 0] = 2
    mode[first] = 0
    wave = x + 2 * y
    # Waves end where few images are as tall; what is left of those goes pixel by pixel.
    most = np.sort(2 * h - 2 + width)[::-1]
    last = int(most[FEW_TALL - 1]) if len(h) >= FEW_TALL else 0
    at = np.flatnonzero(wave < last)
    key = wave[at] << 4 | mode[at]
    order = key.argsort(kind="stable")
    at, key = at[order], key[order]
    begin, many = _rows_of(key)
    for a, b, k in zip(begin.tolist(), (begin + many).tolist(), key[begin].tolist(), strict=True):
        here = at[a:b]
        p[here] = (p[here].view(np.uint8) + _wave_guess(p, here, k & 15, width).view(np.uint8)).view(np.uint32)
    for k in np.flatnonzero(2 * h - 2 + width > last).tolist():
        a, b = int(first[k]), int(first[k] + n[k])
        own, todo = p[a:b].tolist(), np.flatnonzero(wave[a:b] >= last)
        for i, m in zip(todo.tolist(), mode[a:b][todo].tolist(), strict=True):
            if i:
                guess = own[i - 1] if m == 1 else own[i - width] if m == 2 else PREDICTIONS[m](own[i - 1], own[i - width], own[i - width + 1], own[i - width - 1])
            else:
                guess = 0xFF000000
            here = own[i]
            own[i] = (here & _EVEN) + (guess & _EVEN) & _EVEN | (here & _ODD) + (guess & _ODD) & _ODD
        p[a:b] = own
    return [p[a : a + m] for a, m in zip(first.tolist(), n.tolist(), strict=True)]


def decode_streams(streams: list[bytes], paths: list[set[str] | None]) -> list[np.ndarray]:
    """decode_stream of each. Main images of one group are read side by side, and
    predictor and cross-colour of one width and tile undone side by side."""
    try:
        parsed = _side_by_side([_parsed(s, p) for s, p in zip(streams, paths, strict=True)])
        pixels = read_bodies([(x.bits, x.stored, x.height, x.head) for x in parsed])
        stacks: dict[tuple, list[int]] = {}
        for k, x in enumerate(parsed):
            kinds = tuple(t[:3] for t in x.todo)
            if len({t[1:] for t in kinds}) == 1 and tuple(t[0] for t in kinds) in ((PREDICTOR,), (PREDICTOR, CROSS_COLOUR)):
                stacks.setdefault(kinds, []).append(k)
            else:
                pixels[k] = _undone(x, pixels[k])
    except IndexError as e:
        raise ValueError("the stream ends early") from e
    for kinds, own in stacks.items():
        factors = [parsed[k].todo[1][3] for k in own] if len(kinds) > 1 else None
        got = _undo_stack([pixels[k] for k in own], [parsed[k].height for k in own], *kinds[0][1:], [parsed[k].todo[0][3] for k in own], factors)
        for k, p in zip(own, got, strict=True):
            pixels[k] = p
    return [p.reshape(x.height, x.width) for p, x in zip(pixels, parsed, strict=True)]


def files(media: bytes) -> Iterator[bytes]:
    """The lossless bitstreams of one or more files, one after another."""
    at = 0
    while at < len(media):
        if media[at : at + 4] != b"RIFF" or media[at + 8 : at + 12] != b"WEBP":
            raise ValueError("no WebP file")
        end = at + 8 + struct.unpack_from("<I", media, at + 4)[0]
        if end > len(media):
            raise ValueError("the file ends early")
        chunk, found = at + 12, False
        while chunk + 8 <= end:
            n = struct.unpack_from("<I", media, chunk + 4)[0]
            if media[chunk : chunk + 4] == b"VP8L":
                yield media[chunk + 8 : chunk + 8 + n]
                found = True
            chunk += 8 + n + (n & 1)
        if not found:
            raise ValueError("no lossless image")
        at = end


def decode_many(media: list[bytes], paths: list[set[str]] | None = None) -> list[list[np.ndarray]]:
    """decode of each, streams of some megabytes side by side."""
    out, held, size = [[] for _ in media], [], 0

    def flush():
        got = decode_streams([s for _, s in held], [paths[k] if paths else None for k, _ in held])
        for (k, _), p in zip(held, got, strict=True):
            rgba = p & np.uint32(0xFF00FF00) | p >> np.uint32(16) & np.uint32(255) | (p & np.uint32(255)) << np.uint32(16)
            out[k].append(rgba.astype("<u4").view(np.uint8).reshape(*p.shape, 4))
        held.clear()

    for k, m in enumerate(media):
        for stream in files(m):
            if size + len(stream) > TOGETHER or len(held) >= IMAGES:
                flush()
                size = 0
            held.append((k, stream))
            size += len(stream)
    flush()
    return out


def decode(media: bytes, paths: set[str] | None = None) -> list[np.ndarray]:
    """Pixel arrays, uint8 (height, width, RGBA), of all images."""
    return decode_many([media], None if paths is None else [paths])[0]


def code_lengths(counts: np.ndarray, most: int = 15) -> np.ndarray:
    """Huffman code lengths of at most `most` bits."""
    lengths = np.zeros(len(counts), np.int64)
    used = counts.nonzero()[0]
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    own = counts[used].astype(np.int64)
    while True:
        # Two queues: leaves by count, and inner nodes in the order they are made.
        order = own.argsort(kind="stable")
        leaves, n, i, j = own[order].tolist(), len(used), 0, 0
        leaves.append(1 << 62)
        inner, parent = [1 << 62] * n, [0] * (2 * n - 1)
        for new in range(n - 1):
            total = 0
            for _ in (0, 1):
                if leaves[i] <= inner[j]:
                    total += leaves[i]
                    parent[i] = new
                    i += 1
                else:
                    total += inner[j]
                    parent[n + j] = new
                    j += 1
            inner[new] = total
        depth = [0] * (n - 1)
        for node in range(n - 3, -1, -1):
            depth[node] = depth[parent[n + node]] + 1
        deepest = [depth[parent[k]] + 1 for k in range(n)]
        if max(deepest) <= most:
            lengths[used[order]] = deepest
            return lengths
        own = own // 2 + 1


def write_code(out: Writer, lengths: np.ndarray) -> None:
    used = lengths.nonzero()[0].tolist()
    if not used or len(used) <= 2 and used[-1] < 256:
        symbols = used or [0]
        out.put(1 | len(symbols) - 1 << 1 | 4, 3)
        for s in symbols:
            out.put(s, 8)
        return
    runs, at = [], 0
    for s, n in [*zip(used, lengths[used].tolist(), strict=True), (len(lengths), 0)]:
        while at < s:
            zeros = s - at
            if zeros < 3:
                runs += [(0, 0, 0)] * zeros
                break
            zeros = min(zeros, 138)
            runs.append((18, zeros - 11, 7) if zeros >= 11 else (17, zeros - 3, 3))
            at += zeros
        if n:
            runs.append((n, 0, 0))
            at = s + 1
    kinds = [r[0] for r in runs]
    own = code_lengths(np.array([kinds.count(k) for k in range(19)]), 7)
    alone = np.count_nonzero(own) == 1
    codes, widths = canonical(own).tolist(), own.tolist()
    value, at = 15 << 1, 5
    for s in LENGTH_ORDER:
        value |= widths[s] << at
        at += 3
    at += 1
    for s, extra, n in runs:
        if not alone:
            value |= codes[s] << at
            at += widths[s]
        if n:
            value |= extra << at
            at += n
    out.put(value, at)


def file_of(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def repeats(held: bytes, unit: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(place, length, distance) of stretches of at least `least` values of `unit` bytes
    that stood before, left to right and apart; each repeats the latest stretch that
    begins alike. A stretch has eight bytes or more."""
    n = len(held) // unit - least + 1
    if n < 2 or least * unit < 8:
        return
    key = np.ndarray((n,), "<u8", held, strides=(unit,)) * np.uint64(0x9E3779B97F4A7C15)
    if n < 1 << 14:  # sixteen bits keep most stretches apart, and sort by radix
        key = (key >> np.uint64(48)).astype(np.uint16)
    order = key.argsort(kind="stable")
    key = key[order]
    same = (key[1:] == key[:-1]).nonzero()[0]
    places, before = order[same + 1], order[same]
    in_order = places.argsort()
    at, end, width = 0, len(held), least * unit
    for p, q in zip(places[in_order].tolist(), before[in_order].tolist(), strict=True):
        if p < at:
            continue
        here, there = p * unit, q * unit
        if held[here : here + width] != held[there : there + width]:
            continue  # equal hashes alone
        size, step = width, 16
        while here + size < end and size < 4096 * unit:  # steps grow while they agree, then shrink
            step = min(step, end - here - size)
            if held[here + size : here + size + step] == held[there + size : there + size + step]:
                size += step
                step *= 2
            elif step == 1:
                break
            else:
                step //= 2
        n = min(size // unit, 4096)
        at = p + n
        yield p, n, p - q


@lru_cache(64)
def _near(width: int) -> np.ndarray:
    """The least short code of each distance, 0 where none stands for it."""
    out = np.zeros(8 * width + 9, np.int64)
    for k in range(len(NEAR), 0, -1):
        out[_distance(k, width)] = k
    return out


def prefix(value: int) -> tuple[int, str]:
    """Symbol and extra bits of a length or distance code."""
    v = value - 1
    if v < 4:
        return v, ""
    extra = v.bit_length() - 2
    return 2 * extra + (v >> extra), _text(v & (1 << extra) - 1, extra)


def _text(value: int, n: int) -> str:
    """n bits in reading order."""
    return f"{value:0{n}b}"[::-1] if n else ""


def code_texts(lengths: np.ndarray) -> list[str] | None:
    """The bits of each symbol; None where one symbol needs none."""
    used = lengths.nonzero()[0]
    if len(used) < 2:
        return None
    out = [""] * len(lengths)
    for s, code, n in zip(used.tolist(), canonical(lengths)[used].tolist(), lengths[used].tolist(), strict=True):
        out[s] = _text(code, n)
    return out


def _cached(pixels: np.ndarray, bits: int) -> np.ndarray:
    """Slots of the pixels that the colour cache holds when they come, -1 for others."""
    slots = ((pixels.astype(np.uint64) * np.uint64(CACHE_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)).astype(np.int64)
    order = slots.argsort(kind="stable")
    before = np.full(len(pixels), -1, np.int64)
    alike = np.flatnonzero(slots[order][1:] == slots[order][:-1])
    before[order[alike + 1]] = order[alike]
    hit = (before >= 0) & (pixels[before] == pixels)
    return np.where(hit, slots, -1)


def _entropy(counts: list[np.ndarray]) -> float:
    """About the bits of symbols of these counts, with their codes."""
    held = [c[c > 0] for c in counts]
    return sum(float((c * np.log2(c.sum() / c)).sum()) + 4 * len(c) for c in held if len(c) > 1)


def write_pixels(channels: list[np.ndarray], width: int, main: bool, least: int = 0, cache_choices: tuple[int, ...] = (0,)) -> str:
    """Bits of pixels by their green, red, blue and alpha samples; a channel of one
    value may be given once. Back-references take `least` pixels or more (0: none), and
    the colour cache has the size that takes the fewest bits."""
    green, total = channels[0], len(channels[0])
    flat = [len(c) < total for c in channels]
    one = all(flat[1:])
    held = green.tobytes() if one else _argb(channels).tobytes()
    jumps = list(repeats(held, 1 if one else 4, least)) if least else []
    near = _near(width)
    lengths = [prefix(n) for _, n, _ in jumps]
    fars = [prefix(int(near[d]) if d < len(near) and near[d] else d + 120) for _, _, d in jumps]
    # Literals stand between the back-references.
    edges, at = [], 0
    for p, n, _ in jumps:
        edges.append((at, p))
        at = p + n
    edges.append((at, total))
    literal = np.ones(total, bool)
    for p, n, _ in jumps:
        literal[p : p + n] = False
    lengths_seen = np.bincount([256 + s for s, _ in lengths], minlength=280) if jumps else 0
    best = None
    for bits in cache_choices:
        slots = _cached(_argb(channels), bits) if bits else None
        plain = literal if slots is None else literal & (slots < 0)
        first = np.bincount(green[plain], minlength=280) + lengths_seen
        if bits:
            first = np.concatenate([first, np.bincount(slots[literal & (slots >= 0)], minlength=1 << bits)])
        counts = [first] + [np.bincount(c if thin else c[plain], minlength=256) for c, thin in zip(channels[1:], flat[1:], strict=True)]
        cost = _entropy(counts) if len(cache_choices) > 1 else 0.0
        if best is None or cost < best[0]:
            best = cost, bits, slots, counts
    _, bits, slots, counts = best
    counts.append(np.bincount([s for s, _ in fars], minlength=40) if jumps else np.zeros(40, np.int64))
    out = Writer()
    out.put(1 | bits << 1 if bits else 0, 5 if bits else 1)
    if main:
        out.put(0, 1)
    texts = []
    for c in counts:
        seen = c.nonzero()[0]
        if len(seen) < 2 and c is not counts[0]:
            out.put(1 | 4 | int(seen[0]) << 3 if len(seen) else 1 | 4, 11)
            texts.append(None)
            continue
        own = code_lengths(c, 11)  # 11 bits keep a decoder's tables small
        write_code(out, own)
        texts.append(code_texts(own))
    parts = [out.text()]
    nothing = [""] * 256
    first, *others, far = [t or nothing for t in texts]
    if texts[0] is None:
        first = nothing + [""] * 24 + [""] * (1 << bits)
    if far is nothing:
        far = [""] * 40
    sets = [(own, c) for own, c, thin in zip(others, channels[1:], flat[1:], strict=True) if not thin and own is not nothing]
    if bits:
        symbols = np.where(slots >= 0, 280 + slots, green).tolist()
        rest = [c.tolist() for _, c in sets]
        token = [first[s] + ("" if s >= 280 else "".join(own[c[k]] for (own, _), c in zip(sets, rest, strict=True))) for k, s in enumerate(symbols)]
    elif sets:
        token = list(map("".join, zip(map(first.__getitem__, green.tolist()), *(map(own.__getitem__, c.tolist()) for own, c in sets), strict=True)))
    else:
        token, samples = None, green.tobytes()
    get = first.__getitem__
    for k, (a, b) in enumerate(edges):
        parts += token[a:b] if token is not None else map(get, samples[a:b])
        if k < len(jumps):
            (s, extra), (d, also) = lengths[k], fars[k]
            parts += (first[256 + s], extra, far[d], also)
    return "".join(parts)


def _argb(channels: list[np.ndarray]) -> np.ndarray:
    g, r, b, a = (c.astype(np.uint32) for c in channels)
    return a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b


def write_palette(values: list[int]) -> Writer:
    """A palette of opaque colours with these greens: the steps between them, one code each."""
    steps = [values[0]] + [b - a for a, b in zip(values, values[1:], strict=False)]
    counts = np.bincount(steps, minlength=280)
    green = code_lengths(counts)
    none = np.zeros(256, np.int64)
    alpha = none.copy()
    alpha[[0, 255] if len(values) > 1 else [255]] = 1
    out = Writer()
    out.put(0, 1)
    for own in (green, none, none, alpha, none[:40]):
        write_code(out, own)
    codes, widths = (canonical(green).tolist(), green.tolist()) if np.count_nonzero(green) > 1 else ([0] * 280, [0] * 280)
    value = at = 0
    for k, s in enumerate(steps):
        value |= codes[s] << at
        at += widths[s]
        if len(steps) > 1:  # the first colour brings 255, the others leave it
            value |= (not k) << at
            at += 1
    out.put(value, at)
    return out


def _summed(x: np.ndarray) -> np.ndarray:
    """Sums over the tiles of stacked rows (rows, 16) or (rows, 16, 4)."""
    side = 1 << TILE
    down = x.reshape(len(x) // side, side, -1).sum(1, dtype=np.int32)
    return down.reshape(len(down), COLOUR_WIDTH // side, -1).sum(2, dtype=np.int32)


def _of_tiles(x: np.ndarray) -> np.ndarray:
    """Each pixel's value of its tile, by rows."""
    return x.repeat(1 << TILE, 0).repeat(1 << TILE, 1)


def _by_tile(x: np.ndarray) -> np.ndarray:
    """Stacked rows (rows, 16, 4) as a view by tile."""
    side = 1 << TILE
    return x.reshape(len(x) // side, side, COLOUR_WIDTH // side, side, 4).transpose(0, 2, 1, 3, 4)


def _guesses(left: np.ndarray, top: np.ndarray, right: np.ndarray, corner: np.ndarray) -> Iterator[np.ndarray]:
    """What each mode predicts, in order, from neighbours' samples (pixels, RGBA)."""

    def mean(a, b):
        return (a & b) + ((a ^ b) >> np.uint8(1))

    def apart(a, b):
        far = (np.maximum(a, b) - np.minimum(a, b)).astype(np.int16)
        return far[:, 0] + far[:, 1] + far[:, 2] + far[:, 3]

    yield np.broadcast_to(BLACK, left.shape)
    yield from (left, top, right, corner)
    yield mean(mean(left, right), top)
    yield mean(left, corner)
    middle = mean(left, top)
    yield middle
    yield mean(corner, top)
    yield mean(top, right)
    yield mean(mean(left, corner), mean(top, right))
    yield np.where((apart(top, corner) < apart(left, corner))[:, None], left, top)
    yield np.clip(left.astype(np.int16) + top - corner, 0, 255).astype(np.uint8)
    rest = middle.astype(np.int16) - corner
    yield np.clip(middle + (rest + (rest < 0) >> 1), 0, 255).astype(np.uint8)


def predict_stack(rows: np.ndarray, inner: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals and the mode of each tile, that of the smallest residuals, for images
    stacked by rows (rows, 16, RGBA); inner: each row's place in its image."""
    p = rows.reshape(-1, 4)
    n, width = len(p), COLOUR_WIDTH
    held = np.concatenate([np.zeros((width + 1, 4), np.uint8), p])
    left, top, right, corner = (held[k : k + n] for k in (width, 1, 2, 0))
    guess, best, modes, edge = np.empty_like(rows), None, None, ~valid | (inner == 0)
    for mode, g in enumerate(_guesses(left, top, right, corner)):
        off = p - g
        off = np.minimum(off, np.uint8(0) - off).reshape(rows.shape)
        off[edge] = 0  # edges are predicted in one way whatever the mode
        off[:, 0] = 0
        cost = _summed(off)
        less = np.ones(cost.shape, bool) if best is None else cost < best
        best = cost if best is None else np.where(less, cost, best)
        modes = np.where(less, mode, 0 if modes is None else modes).astype(np.uint8)
        _by_tile(guess)[less] = _by_tile(np.ascontiguousarray(g).reshape(rows.shape))[less]
    first = inner == 0
    guess[:, 0] = top.reshape(rows.shape)[:, 0]
    guess[first] = left.reshape(rows.shape)[first]
    guess[first, 0] = BLACK
    out = rows - guess
    out[~valid] = 0
    return out, modes


def cross_stack(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples without what green (and red) tell of them, and each tile's factors (red to
    blue, green to blue, green to red) by least squares where they help."""
    red, green, blue = (np.ascontiguousarray(rows[..., k]).view(np.int8).astype(np.int16) for k in range(3))

    def without(target, source, f):
        return (target - (_of_tiles(f) * source >> 5)).astype(np.int8).astype(np.int16)

    def factor(target, source):
        product, square = _summed(target.astype(np.int32) * source), _summed(source.astype(np.int32) * source)
        f = np.clip(np.rint(32 * product / np.maximum(1, square)), -128, 127).astype(np.int16)
        less = _summed(np.abs(without(target, source, f))) < _summed(np.abs(target))
        return np.where(less, f, 0).astype(np.int16)

    to_red, to_blue = factor(red, green), factor(blue, green)
    rest = without(blue, green, to_blue)
    also = factor(rest, red)
    out = rows.copy()
    out[..., 0] = without(red, green, to_red).astype(np.uint8)
    out[..., 2] = without(rest, red, also).astype(np.uint8)
    return out, np.stack([also, to_blue, to_red], -1).astype(np.uint8)


def _rows_of(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First entry and number of entries of each row, entries being sorted by row."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    return first, np.diff(first, append=len(row))


def many_lengths(row: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of at most `most` bits of many codes side by side. Entries
    are the used symbols, sorted by code; a lone symbol has length 1."""
    out, own = np.ones(len(row), np.int64), counts.astype(np.int64)
    first, n = _rows_of(row)
    queue = [np.flatnonzero((n > least) & (n <= full)) for least, full in ((1, 16), (16, 64), (64, 128), (128, 1 << 15))]
    while queue:
        todo = queue.pop()
        if not len(todo):
            continue
        todo = todo[(-n[todo]).argsort(kind="stable")]  # long codes first: those still at work are the first ones
        m, codes = n[todo], len(todo)
        top = int(m[0])
        inside = np.arange(top) < m[:, None]
        at = (first[todo][:, None] + np.arange(top))[inside]
        leaves = np.full((codes, top + 1), 1 << 30, np.int32)
        leaves[:, :top][inside] = own[at]
        order = leaves[:, :top].argsort(1, kind="stable")
        leaves[:, :top] = np.take_along_axis(leaves[:, :top], order, 1)
        inner, up = np.full((codes, top + 1), 1 << 30, np.int32), np.zeros((codes, 2 * top + 1), np.int64)
        # Two queues: leaves by count, and inner nodes in the order they are made.
        leaf_at, inner_at, up_at = np.arange(codes) * (top + 1), np.arange(codes) * (top + 1), np.arange(codes) * (2 * top + 1)
        held, made, parents, leaf_first = leaves.ravel(), inner.ravel(), up.ravel(), leaf_at.copy()
        working = np.searchsorted(-m, -np.arange(2, top + 2), side="right").tolist()
        for new in range(top - 1):
            w = working[new]
            i, j, base, start = leaf_at[:w], inner_at[:w], up_at[:w], leaf_first[:w]
            total = 0
            for _ in (0, 1):
                x, y = held.take(i), made.take(j)
                leaf = x <= y
                total = total + np.minimum(x, y)
                parents[base + np.where(leaf, i, j + top) - start] = new
                i += leaf
                j += ~leaf
            inner[:w, new] = total
        depth = np.zeros((codes, top), np.int64)
        flat, row_at = depth.ravel(), np.arange(codes) * top
        for node in range(top - 3, -1, -1):
            w = working[node + 1]
            depth[:w, node] = flat.take(row_at[:w] + up[:w, top + node]) + 1
        deep = np.empty((codes, top), np.int64)
        np.put_along_axis(deep, order, np.take_along_axis(depth, up[:, :top], 1) + 1, 1)
        fits = np.where(inside, deep, 0).max(1) <= most
        out[at] = deep[inside]
        own[at] = own[at] // 2 + 1
        queue.append(todo[~fits])
    return out


def many_codes(row: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Codes of the entries of many codes, with their bits in reading order."""
    order = (row * 16 + lengths).argsort(kind="stable")
    width = np.int64(1) << 15 - lengths[order]
    start = width.cumsum() - width
    first, n = _rows_of(row)
    out = np.empty(len(row), np.int64)
    out[order] = _REVERSED[start - start[first].repeat(n)]
    return out


def _within(sizes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bits before each token in its row of tokens."""
    before = sizes.cumsum() - sizes
    return before - before[first].repeat(n)


def _code_tokens(row: np.ndarray, symbols: np.ndarray, lengths: np.ndarray, alphabets: np.ndarray) -> tuple[np.ndarray, ...]:
    """How the codes of all rows are written: row, bits before, value and size of each
    token, and the bits of each row. Entries are sorted by row; rows may have none."""
    rows = len(alphabets)
    n = np.bincount(row, minlength=rows)
    first = n.cumsum() - n
    last = np.where(n > 0, np.append(symbols, 0)[first + n - 1], 0)
    simple = (n <= 2) & (last < 256)
    one = np.where(n > 0, np.append(symbols, 0)[np.minimum(first, len(symbols))], 0)
    value = np.where(n == 2, 7 | one << 3 | last << 11, 5 | one << 3).astype(np.uint64)
    size = np.where(n == 2, 19, 11)
    # Others: lengths with runs of zeros, up to the end of the alphabet.
    rest = np.flatnonzero(~simple)
    keep = ~simple[row]
    ends = n[rest].cumsum()
    r = np.insert(row[keep], ends, rest)
    s = np.insert(symbols[keep], ends, alphabets[rest])
    held = np.insert(lengths[keep], ends, 0)
    start, many = _rows_of(r)
    gap = s - np.concatenate([[0], s[:-1] + 1])[: len(s)]
    gap[start] = s[start]
    full, part = gap // 138, gap % 138
    tail = np.where(part >= 3, 1, part)
    tokens = full + tail + (held > 0)
    of = np.arange(len(s)).repeat(tokens)
    k = np.arange(len(of)) - (tokens.cumsum() - tokens).repeat(tokens)
    in_full, in_tail, p = k < full[of], k < (full + tail)[of], part[of]
    kind = np.where(in_full, 18, np.where(in_tail, np.where(p >= 11, 18, np.where(p >= 3, 17, 0)), held[of]))
    extra = np.where(in_full, 127, np.where(in_tail & (p >= 3), np.where(p >= 11, p - 11, p - 3), 0))
    wide = np.where(kind == 18, 7, np.where(kind == 17, 3, 0))
    owner = r[of]
    at = owner * 19 + kind
    counts = np.bincount(at, minlength=rows * 19)
    key = counts.nonzero()[0]
    own = many_lengths(key // 19, counts[key], 7)
    code = many_codes(key // 19, own)
    lone = np.zeros(rows, bool)
    lone[rest] = np.bincount(key // 19, minlength=rows)[rest] == 1
    table_n, table_c = np.zeros(rows * 19, np.int64), np.zeros(rows * 19, np.int64)
    table_n[key], table_c[key] = own, code
    widths = table_n.reshape(rows, 19)[rest][:, LENGTH_ORDER].astype(np.uint64)
    value[rest] = np.uint64(15 << 1) | (widths << (5 + 3 * np.arange(19, dtype=np.uint64))).sum(1, dtype=np.uint64)
    size[rest] = 63
    bits = np.where(lone[owner], 0, table_n[at])
    token_n = bits + wide
    token = (np.where(bits > 0, table_c[at], 0) | extra << bits).astype(np.uint64)
    begin, held_n = _rows_of(owner)
    inside = 63 + _within(token_n, begin, held_n)
    total = size + np.bincount(owner, token_n, rows).astype(np.int64)
    return np.concatenate([np.arange(rows), owner]), np.concatenate([np.zeros(rows, np.int64), inside]), np.concatenate([value, token]), np.concatenate([size, token_n]), total


def _put(words: np.ndarray, at: np.ndarray, value: np.ndarray, n: np.ndarray) -> None:
    """Write values of n bits at bit positions, which do not overlap."""
    shift = (at & 63).astype(np.uint64)
    np.add.at(words, at >> 6, value << shift)
    over = np.flatnonzero((at & 63) + n > 64)
    np.add.at(words, (at[over] >> 6) + 1, value[over] >> np.uint64(64) - shift[over])


def _slots(argb: np.ndarray, ids: np.ndarray, bits: int) -> np.ndarray:
    """Slots of the pixels that their image's colour cache holds when they come, -1 for others."""
    slots = (argb * np.uint32(CACHE_FACTOR) >> np.uint32(32 - bits)).astype(np.uint16)  # sixteen bits sort by radix
    order = slots.argsort(kind="stable")
    colour, image = argb[order], ids[order]
    hit = np.zeros(len(argb), bool)
    hit[order[1:]] = (colour[1:] == colour[:-1]) & (image[1:] == image[:-1])  # equal pixels have one slot
    return np.where(hit, slots.astype(np.int64), -1)


def _spread(ids: np.ndarray, symbols: np.ndarray, images: int, alphabet: int) -> np.ndarray:
    """About the bits of symbols by image, with their codes."""
    counts = np.bincount(ids * alphabet + symbols, minlength=images * alphabet)
    used = counts.nonzero()[0]
    c, image = counts[used], used // alphabet
    total, n = np.bincount(ids, minlength=images), np.bincount(image, minlength=images)
    bits = total * np.log2(np.maximum(1, total)) - np.bincount(image, c * np.log2(c), images) + 4 * n
    return np.where(n > 1, bits, 0)


def colour_files(images: list[np.ndarray], least: int = 3, caches: tuple[int, ...] = (0, 6, 10)) -> list[bytes]:
    """A file for each image of four samples a pixel (RGBA), by predictor and cross-colour
    tiles, back-references of `least` pixels or more, and the colour cache of the size that
    takes the fewest bits (0: none). All images are worked on side by side; a file depends
    on its own image alone."""
    side, width, docs = 1 << TILE, COLOUR_WIDTH, len(images)
    heights = np.array([len(x) // WIDTH for x in images])
    tall = -(-heights // side) * side
    inner = np.arange(tall.sum()) - (tall.cumsum() - tall).repeat(tall)
    valid = inner < heights.repeat(tall)
    rows = np.zeros((len(inner), width, 4), np.uint8)
    rows[valid] = np.concatenate(images).reshape(-1, width, 4)
    residual, modes = predict_stack(rows, inner, valid)
    crossed, factors = cross_stack(residual)
    # Three images a file: modes, factors, pixels, each as green, red, blue, alpha.
    tiles = (tall // side) * (width // side)
    sizes = np.concatenate([tiles, tiles, heights * width])
    image = np.concatenate([np.arange(docs) * 3 + k for k in range(3)])
    ids = image.repeat(sizes)
    first = sizes.cumsum() - sizes
    flat = np.zeros((len(ids), 4), np.uint8)
    flat[:, 3] = 255
    half = int(tiles.sum())
    flat[:half, 0] = modes.ravel()
    flat[half : 2 * half, :3] = factors.reshape(-1, 3)[:, [1, 0, 2]]
    flat[2 * half :] = crossed[valid].reshape(-1, 4)[:, [1, 0, 2, 3]]
    total = 3 * docs
    # Back-references, with their lengths and distances as codes.
    main = np.ascontiguousarray(flat[2 * half :])
    near, token, symbol = _near(width), np.ones(len(ids), bool), flat[:, 0].astype(np.int64)
    jumps = []
    for d in range(docs):
        at = int(first[2 * docs + d])
        for p, n, far in repeats(main[at - 2 * half : at - 2 * half + int(heights[d]) * width].tobytes(), 4, least):
            token[at + p + 1 : at + p + n] = False
            jumps.append((at + p, n, int(near[far]) if far < len(near) and near[far] else far + 120))
    where, long, far = np.array(jumps, np.int64).reshape(-1, 3).T
    jump = np.zeros(len(ids), bool)
    jump[where] = True
    (long, long_bits, long_n), (far, far_bits, far_n) = _prefixes(long), _prefixes(far)
    literal = token & ~jump
    # The colour cache of each main image.
    own_ids, own_literal = ids[2 * half :] // 3, literal[2 * half :]
    g, r, b, a = (main[:, k].astype(np.uint32) for k in range(4))
    argb = a << np.uint32(24) | r << np.uint32(16) | g << np.uint32(8) | b
    in_jumps = where - 2 * half
    costs, found = [], []
    for bits in caches:
        slots = _slots(argb, own_ids, bits) if bits else np.full(len(argb), -1)
        plain, cached = own_literal & (slots < 0), own_literal & (slots >= 0)
        plain, cached = plain.nonzero()[0], cached.nonzero()[0]
        kept = own_ids[plain]
        seen = np.concatenate([main[plain, 0], 256 + long, 280 + slots[cached]])
        cost = _spread(np.concatenate([kept, own_ids[in_jumps], own_ids[cached]]), seen, docs, 280 + (1 << bits))
        costs.append(cost + sum(_spread(kept, main[plain, k], docs, 256) for k in (1, 2, 3)))
        found.append(slots)
    choice = np.array(costs).argmin(0)
    cache = np.zeros(total, np.int64)
    cache[2::3] = np.array(caches)[choice]
    slots = np.choose(choice[own_ids], found)
    symbol[2 * half :] = np.where(slots >= 0, 280 + slots, symbol[2 * half :])
    symbol[where] = 256 + long
    whole = token & (symbol < 256)  # pixels written by all four samples
    # Codes: a row for each image and alphabet.
    wide = 280 + (1 << int(cache.max()) if cache.any() else 0)
    place = np.flatnonzero(whole)
    of_place = ids[place]
    keys = [(of_place, symbol[place], 256)] + [(of_place, flat[place, k], 256) for k in (1, 2, 3)] + [(ids[where], far, 40)]
    odd = np.flatnonzero(token & (symbol >= 256))
    row, symbols, counts = [], [], []
    for k, (own, s, alphabet) in enumerate(keys):
        c = np.bincount(own * alphabet + s, minlength=total * alphabet)
        used = c.nonzero()[0]
        row.append(used // alphabet + k * total)
        symbols.append(used % alphabet)
        counts.append(c[used])
        if not k and len(odd):  # lengths and slots, behind each image's samples
            key, c = np.unique(ids[odd] * wide + symbol[odd], return_counts=True)
            at = np.searchsorted(row[0], key // wide, side="right")
            row[0], symbols[0], counts[0] = (np.insert(x, at, y) for x, y in ((row[0], key // wide), (symbols[0], key % wide), (counts[0], c)))
    row, symbols, counts = map(np.concatenate, (row, symbols, counts))
    lengths = many_lengths(row, counts, 11)  # 11 bits keep a decoder's tables small
    codes = many_codes(row, lengths)
    alphabets = np.concatenate([280 + np.where(cache > 0, 1 << cache, 0), np.full(3 * total, 256), np.full(total, 40)])
    code_row, code_at, code_value, code_n, code_bits = _code_tokens(row, symbols, lengths, alphabets)
    # Samples, as the bits of their codes; a lone symbol takes none.
    n_of = np.where(np.bincount(row, minlength=5 * total)[row] > 1, lengths, 0)
    c_of = np.where(n_of > 0, codes, 0).astype(np.uint64)
    value, size = np.zeros(len(ids), np.uint64), np.zeros(len(ids), np.int64)

    def add(at, own, s, k, alphabet):
        mine = row // total == k
        table = np.zeros(total * alphabet, np.int64)
        table[(row[mine] - k * total) * alphabet + symbols[mine]] = np.flatnonzero(mine)
        entry = table[own * alphabet + s]
        value[at] |= c_of[entry] << size[at].astype(np.uint64)
        size[at] += n_of[entry]

    add(odd, ids[odd], symbol[odd], 0, wide)
    add(place, of_place, symbol[place], 0, wide)
    for k in (1, 2, 3):
        add(place, of_place, flat[place, k], k, 256)
    if len(where):
        value[where] |= long_bits.astype(np.uint64) << size[where].astype(np.uint64)
        size[where] += long_n
        add(where, ids[where], far, 4, 40)
        value[where] |= far_bits.astype(np.uint64) << size[where].astype(np.uint64)
        size[where] += far_n
    # Places of all parts: head, five codes, samples, image by image.
    head, head_n = np.zeros(total, np.int64), np.zeros(total, np.int64)
    tile = TILE - 2 << 3
    head[0::3] = 0x2F | width - 1 << 8 | heights - 1 << 22 | (1 | PREDICTOR << 1 | tile) << 40
    head[1::3] = 1 | CROSS_COLOUR << 1 | tile
    head_n[0::3], head_n[1::3] = 47, 7  # and no cache
    head[2::3] = np.where(cache[2::3] > 0, 2 | cache[2::3] << 2, 0)  # no more transforms, no groups
    head_n[2::3] = np.where(cache[2::3] > 0, 7, 3)
    sections = np.empty((total, 7), np.int64)
    sections[:, 0] = head_n
    sections[:, 1:6] = code_bits.reshape(5, total).T
    sections[image, 6] = np.add.reduceat(size, first)
    by_file = sections.reshape(docs, 21)
    n_bytes = (by_file.sum(1) + 7) // 8
    begin = n_bytes.cumsum() - n_bytes
    base = (8 * begin[:, None] + by_file.cumsum(1) - by_file).reshape(total, 7)
    words = np.zeros(int(n_bytes.sum()) // 8 + 3, np.uint64)
    _put(words, base[:, 0], head.astype(np.uint64), head_n)
    _put(words, base[code_row % total, 1 + code_row // total] + code_at, code_value, code_n)
    at = np.flatnonzero(size)
    _put(words, (base[ids, 6] + _within(size, first, sizes))[at], value[at], size[at])
    held = words.astype("<u8").tobytes()
    return [file_of(held[a : a + n]) for a, n in zip(begin.tolist(), n_bytes.tolist(), strict=True)]


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of length or distance codes, with their extra bits and how many."""
    v = values - 1
    extra = np.where(v < 4, 0, np.frexp(v.astype(float))[1] - 2)
    return np.where(v < 4, v, 2 * extra + (v >> extra)), np.where(v < 4, 0, v & (1 << extra) - 1), extra


def _head(width: int, height: int) -> Writer:
    out = Writer()
    out.put(0x2F | width - 1 << 8 | height - 1 << 22, 40)
    return out


def _stream(parts: list[Writer | str]) -> bytes:
    bits = "".join(p.text() if isinstance(p, Writer) else p for p in parts)
    return file_of(int(bits[::-1], 2).to_bytes((len(bits) + 7) // 8, "little"))


OPAQUE, ZERO = np.array([255], np.uint8), np.zeros(1, np.uint8)


def encode_samples(samples: np.ndarray, palette: bool = True, width: int = WIDTH, least: int = 12) -> bytes:
    """A file of one image, a sample a pixel in its green channel, or by a palette of the samples."""
    height, index, n = len(samples) // width, samples, 0
    parts = [_head(width, height)]
    if palette:
        values = np.bincount(samples, minlength=256).nonzero()[0]
        place = np.zeros(256, np.uint8)
        place[values] = np.arange(len(values))
        index, n = place[samples], bundle_bits(len(values))
        parts[0].put(1 | PALETTE << 1 | len(values) - 1 << 3, 11)
        parts.append(write_palette(values.tolist()))
        if n:
            index = (index.reshape(-1, 1 << n) << (np.arange(1 << n, dtype=np.uint8) * np.uint8(8 >> n))).sum(-1, dtype=np.uint8)
    return _stream([*parts, "0", write_pixels([index, ZERO, ZERO, OPAQUE], width >> n, True, least)])


def payload(data: bytes, unit: int = WIDTH) -> bytes:
    """data with bytes 0 up to a positive multiple of unit."""
    return data + bytes(-len(data) % unit or (0 if data else unit))


LAYOUTS = ("samples", "palette", "colours")


def encode_many(texts: list[bytes], layout: str | None = None) -> list[bytes]:
    """encode of each, those stored as colours side by side."""
    step, out, waiting, size = WIDTH * ROWS, [[] for _ in texts], [], 0

    def flush():
        for (k, _), file in zip(waiting, colour_files([x for _, x in waiting]) if waiting else [], strict=True):
            out[k].append(file)
        waiting.clear()

    for k, data in enumerate(texts):
        held = payload(data)
        samples = np.frombuffer(held, np.uint8)
        parts = [samples[at : at + step] for at in range(0, len(samples), step)]
        own = layout or ("palette" if len(set(held)) <= 16 else "colours")
        if own != "colours":
            out[k] = [encode_samples(x, own == "palette") for x in parts]
            continue
        for x in parts:
            if size + len(x) > TOGETHER or len(waiting) >= IMAGES:
                flush()
                size = 0
            waiting.append((k, x))
            size += len(x)
    flush()
    return [b"".join(x) for x in out]


def encode(data: bytes, layout: str | None = None) -> bytes:
    """One file or more, in one of LAYOUTS. None: four samples a pixel by the image
    transforms, or a palette where the payload has 16 values at most, so that pixels
    share a byte."""
    return encode_many([data], layout)[0]


def stored_bytes(pixels: np.ndarray) -> bytes:
    """The samples of one pixel array that `encode` stored."""
    return (pixels if pixels.shape[1] == WIDTH // 4 else pixels[..., 1]).tobytes()


def read_payloads(media: list[bytes], paths: list[set[str]] | None = None) -> list[bytes]:
    """The payloads that `encode_many` stored, by their pixel arrays."""
    return [b"".join(stored_bytes(p) for p in own) for own in decode_many(media, paths)]


def read_payload(media: bytes, paths: set[str] | None = None) -> bytes:
    """The payload that `encode` stored, by its pixel arrays."""
    return read_payloads([media], None if paths is None else [paths])[0]


def features(samples: np.ndarray) -> str:
    """Mean, deviation and a histogram of 16 bins in thousandths."""
    share = np.bincount(samples >> 4, minlength=16) * 1000 // max(1, len(samples))
    return f"{samples.mean():.3f};{samples.std():.3f};" + ".".join(map(str, share))


def _gathered(batches: Iterator[pd.Series]) -> Iterator[list[bytes]]:
    """Batches put together, up to the bytes that are worked on side by side."""
    held, size = [], 0
    for batch in batches:
        held += batch.tolist()
        size += sum(map(len, batch))
        if size >= TOGETHER * 3 // 4 or len(held) >= IMAGES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in _gathered(pd.Series([(t or "").encode("utf-8", "surrogatepass") for t in b], dtype=object) for b in texts):
        yield pd.Series(encode_many(batch), dtype=object)


def _digests(media: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in _gathered(media):
        rows, paths = [], [set() for _ in batch]
        for m, got, own in zip(batch, read_payloads(batch, paths), paths, strict=True):
            rows.append((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-WIDTH:]), len(m), hashlib.sha256(m).hexdigest(), features(np.frombuffer(got, np.uint8)), ",".join(sorted(own))))
        yield pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "paths"])


def _pixels(media: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in media:
        images = iter(decode_many([m for m in batch if m is not None]))
        yield pd.Series([None if m is None else [{"width": p.shape[1], "height": p.shape[0], "rgba": p.tobytes()} for p in next(images)] for m in batch], dtype=object)


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with each text's payload as lossless WebP."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(media, F.pandas_udf(_encoded, "binary")(text))


def with_pixels(docs: DataFrame, media: str = "media", pixels: str = "pixels") -> DataFrame:
    """docs with the decoded pixel arrays of a media column; null media gives null."""
    return docs.withColumn(pixels, F.pandas_udf(_pixels, "array<struct<width:int,height:int,rgba:binary>>")(media))


def report(docs: DataFrame) -> DataFrame:
    stored = with_media(docs.select("doc_id", "text"))
    return stored.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.pandas_udf(_digests, DIGESTS)("media").alias("d")).select("doc_id", "n_bytes", "d.*")
