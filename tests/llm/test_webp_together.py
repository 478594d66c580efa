"""Payloads that are encoded and decoded side by side, and what their layout leaves out."""

import random

import numpy as np
import pytest

from sonolith.llm import webp

WORDS = ["alpha", "beta", "gamma", "delta", "εζ", "x = 1;", "\n", "0123456789", "The"]


def texts(n, most=900):
    rng = random.Random(n)
    return [" ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.randrange(1, most) if k % 9 else most)).encode() for k in range(n)]


def test_every_payload_takes_the_image_transforms():
    data = texts(70, 40)
    paths = [set() for _ in data]
    assert webp.read_payloads(webp.encode_many(data), paths) == [webp.payload(x) for x in data]
    for x, seen in zip(data, paths, strict=True):
        few = len(set(webp.payload(x))) <= 16
        assert seen >= ({"palette"} if few else {"predictor", "cross-colour"}), x


def test_a_file_depends_on_its_own_payload_alone():
    data = [*texts(90), b"", b"a", bytes(range(256)) * 40, b"ab" * 300, np.random.default_rng(1).bytes(5000), b"same words again " * 500]
    together = webp.encode_many(data)
    assert together == [webp.encode(x) for x in data] == webp.encode_many(data[::-1])[::-1]
    many, alone = [set() for _ in data], [set() for _ in data]
    assert webp.read_payloads(together, many) == [webp.read_payload(m, p) for m, p in zip(together, alone, strict=True)] == [webp.payload(x) for x in data]
    assert many == alone


@pytest.mark.parametrize("layout", webp.LAYOUTS)
def test_layouts_may_be_mixed(layout, monkeypatch):
    data = texts(40, 200)
    media = webp.encode_many(data, layout) + webp.encode_many(data)
    assert webp.read_payloads(media) == [webp.payload(x) for x in data] * 2
    monkeypatch.setattr(webp, "TOGETHER", 3000)
    assert webp.encode_many(data, layout) + webp.encode_many(data) == media
    assert webp.read_payloads(media) == [webp.payload(x) for x in data] * 2


@pytest.mark.parametrize("cut", [12, 40, 70, 200, -40, -3])
def test_one_damaged_stream_of_many(cut):
    media = webp.encode_many(texts(60, 300))
    stream = next(webp.files(media[30]))
    media[30] = webp.file_of(stream[:cut])
    with pytest.raises(ValueError):
        webp.read_payloads(media)


def test_lengths_side_by_side_are_huffmans():
    rng = np.random.default_rng(3)
    counts = [rng.integers(1, 1 + 10 ** rng.integers(1, 6), rng.integers(1, 280)) for _ in range(60)] + [np.array([1, 1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048])]
    row = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    for most in (15, 11):
        assert webp.many_lengths(row, np.concatenate(counts), most).tolist() == np.concatenate([webp.code_lengths(c, most) for c in counts]).tolist()


def test_short_payloads_are_bounded_in_number(monkeypatch):
    sizes, own = [], webp.colour_files
    monkeypatch.setattr(webp, "IMAGES", 50)
    monkeypatch.setattr(webp, "colour_files", lambda x: sizes.append(len(x)) or own(x))
    data = [bytes(range(k % 100, k % 100 + 40)) for k in range(180)]
    assert webp.read_payloads(webp.encode_many(data)) == [webp.payload(x) for x in data]
    assert sizes == [50, 50, 50, 30]
    batches = [webp.pd.Series([b""] * 20, dtype=object)] * 8
    assert [len(x) for x in webp._gathered(iter(batches))] == [60, 60, 40]
