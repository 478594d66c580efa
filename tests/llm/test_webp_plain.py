"""The encoder's files through a plain decoder, written bit by bit from the format's
description and sharing nothing with the library, and the parts of the format used."""

import os
import random
from collections import Counter

import pytest

from sonolith.llm import webp

ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)


def near_table():
    """(x, y) of the short distance codes: by distance, then nearest to the row above."""
    places = [(x, y) for y in range(8) for x in range(-7, 9) if y > 0 or x > 0]
    return sorted(places, key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], -p[0]))


class Plain:
    def __init__(self, data):
        self.bits = [byte >> k & 1 for byte in data for k in range(8)]
        self.at = 0

    def read(self, n):
        out = sum(self.bits[self.at + k] << k for k in range(n))
        self.at += n
        return out

    def table(self, lengths):
        used = sorted((n, s) for s, n in enumerate(lengths) if n)
        if len(used) < 2:
            return used[0][1] if used else 0
        codes, code, last = {}, 0, 0
        for n, s in used:
            code <<= n - last
            codes[n, code] = s
            code, last = code + 1, n
        return codes

    def symbol(self, table):
        if isinstance(table, int):
            return table
        n = code = 0
        while (n, code) not in table:
            code, n = code << 1 | self.read(1), n + 1
        return table[n, code]

    def code(self, alphabet):
        if self.read(1):
            two, wide = self.read(1), self.read(1)
            symbols = [self.read(8 if wide else 1)] + ([self.read(8)] if two else [])
            return self.table([int(s in symbols) for s in range(256)])
        own = [0] * 19
        for k in range(4 + self.read(4)):
            own[ORDER[k]] = self.read(3)
        table, lengths, last = self.table(own), [], 8
        left = 2 + self.read(2 + 2 * self.read(3)) if self.read(1) else alphabet
        while len(lengths) < alphabet and left:
            left -= 1
            s = self.symbol(table)
            if s < 16:
                lengths.append(s)
                last = s or last
            else:
                lengths += [last] * (3 + self.read(2)) if s == 16 else [0] * (3 + self.read(3) if s == 17 else 11 + self.read(7))
        return self.table(lengths + [0] * (alphabet - len(lengths)))

    def number(self, s):
        if s < 4:
            return s + 1
        extra = s - 2 >> 1
        return (2 + (s & 1) << extra) + self.read(extra) + 1

    def image(self, width, height, main):
        cache_bits = self.read(4) if self.read(1) else 0
        assert not main or not self.read(1)  # the encoder makes one group
        cache = [(0, 0, 0, 0)] * (1 << cache_bits if cache_bits else 0)
        green, red, blue, alpha, far = [self.code(n) for n in (280 + len(cache), 256, 256, 256, 40)]
        out = []

        def put(p):
            out.append(p)
            if cache:
                a, r, g, b = p
                cache[(0x1E35A7BD * (a << 24 | r << 16 | g << 8 | b) & 0xFFFFFFFF) >> 32 - cache_bits] = p

        while len(out) < width * height:
            s = self.symbol(green)
            if s < 256:
                r, b = self.symbol(red), self.symbol(blue)
                put((self.symbol(alpha), r, s, b))
            elif s < 280:
                n, d = self.number(s - 256), self.number(self.symbol(far))
                d = max(1, near_table()[d - 1][0] + near_table()[d - 1][1] * width) if d <= 120 else d - 120
                for _ in range(n):
                    put(out[-d])
            else:
                put(cache[s - 280])
        return out

    def decode(self):
        assert self.read(8) == 0x2F
        width, height = self.read(14) + 1, self.read(14) + 1
        self.read(4)
        todo, stored = [], width
        while self.read(1):
            kind = self.read(2)
            if kind < 2:
                block = self.read(3) + 2
                across = -(-stored // (1 << block))
                own = self.image(across, -(-height // (1 << block)), False)
                todo.append((kind, lambda x, y, own=own, block=block, across=across: own[(y >> block) * across + (x >> block)]))
            else:
                assert kind == 3
                table, now = [], (0, 0, 0, 0)
                for step in self.image(self.read(8) + 1, 1, False):
                    now = tuple(a + b & 255 for a, b in zip(now, step, strict=True))
                    table.append(now)
                todo.append((kind, table))
                per = 8 if len(table) <= 2 else 4 if len(table) <= 4 else 2 if len(table) <= 16 else 1
                stored = -(-stored // per)
        p = self.image(stored, height, True)
        for kind, how in reversed(todo):
            if kind == 3:
                per = 8 if len(how) <= 2 else 4 if len(how) <= 4 else 2 if len(how) <= 16 else 1
                p = [how[p[y * stored + x // per][2] >> x % per * (8 // per) & (1 << 8 // per) - 1] for y in range(height) for x in range(width)]
            elif kind == 1:
                p = [self.crossed(q, how(k % width, k // width)) for k, q in enumerate(p)]
            else:
                for k in range(len(p)):
                    p[k] = tuple(a + b & 255 for a, b in zip(p[k], self.guess(p, k, width, how), strict=True))
        return width, height, p

    @staticmethod
    def crossed(pixel, factors):
        signed = lambda v: v - 256 if v > 127 else v
        a, r, g, b = pixel
        _, red_blue, green_blue, green_red = factors
        r = r + (signed(green_red) * signed(g) >> 5) & 255
        b = b + (signed(green_blue) * signed(g) >> 5) + (signed(red_blue) * signed(r) >> 5) & 255
        return a, r, g, b

    @staticmethod
    def guess(p, k, width, modes):
        x, y = k % width, k // width
        if not k:
            return 255, 0, 0, 0
        if not y:
            return p[k - 1]
        if not x:
            return p[k - width]
        left, top, right, corner = p[k - 1], p[k - width], p[k - width + 1], p[k - width - 1]
        mean = lambda u, v: tuple((i + j) // 2 for i, j in zip(u, v, strict=True))
        mode = modes(x, y)[2] & 15
        if mode == 11:
            whole = [i + j - c for i, j, c in zip(left, top, corner, strict=True)]
            away = lambda u: sum(abs(i - j) for i, j in zip(whole, u, strict=True))
            return left if away(left) < away(top) else top
        if mode == 12:
            return tuple(min(255, max(0, i + j - c)) for i, j, c in zip(left, top, corner, strict=True))
        if mode == 13:
            return tuple(min(255, max(0, m + int((m - c) / 2))) for m, c in zip(mean(left, top), corner, strict=True))
        each = [(255, 0, 0, 0), left, top, right, corner, mean(mean(left, right), top), mean(left, corner), mean(left, top), mean(corner, top), mean(top, right), mean(mean(left, corner), mean(top, right))]
        return each[mode] if mode < 11 else each[0]


def plain_payload(media):
    out = b""
    for stream in webp.files(media):
        width, _, p = Plain(stream).decode()
        out += bytes(v for a, r, g, b in p for v in (r, g, b, a)) if width == 16 else bytes(q[2] for q in p)
    return out


def texts():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh é", k=rng.randint(2, 9))) for _ in range(60)]
    out = ["", "a", "ab" * 400, "x" * 5000, "-" * 64 + "\n", "漢字" * 90, "".join(map(chr, range(1, 600)))]
    for n in (5, 40, 200, 500):
        said = " ".join(rng.choices(words, k=n))
        out += [said, said + said[: n * 2] + said, "\n".join([said[:63]] * 12)]
    return [t.encode() for t in out]


def test_near_table_is_the_formats():
    assert len(near_table()) >= 120 and sorted(near_table()[:120]) == sorted(webp.NEAR)
    assert {webp._distance(k + 1, 64) for k in range(120)} <= {max(1, x + 64 * y) for x, y in near_table()}


@pytest.mark.parametrize("layout", [None, *webp.LAYOUTS])
def test_plain_decoder_reads_the_payload(layout, monkeypatch):
    monkeypatch.setitem(globals(), "near_table", lambda: webp.NEAR)  # a fixed value of the format
    paths = set()
    for data in texts():
        media = webp.encode(data, layout)
        assert plain_payload(media) == webp.payload(data) == webp.read_payload(media, paths)
    if layout == "palette":
        assert paths == {"palette", "back-references"}
    if layout == "colours":
        assert paths == {"predictor", "cross-colour", "cache", "back-references"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_query_takes_every_way_of_the_decoder(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = Counter(x for r in webp.report(docs).select("paths").collect() for x in r["paths"].split(",") if x)
    assert set(seen) == {"palette", "predictor", "cross-colour", "cache", "back-references"}
    assert min(seen.values()) >= 3
