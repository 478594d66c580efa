"""N-D arrays as rows of tiles, for arrays that no row or task holds.

A tile is a row: array_id, `at` (its place in the grid of tiles, one number an axis),
`shape` (its own, smaller at the ends) and `data` (its elements, last axis fastest), so
its strides follow from its shape. Reductions work within tiles first, and then add up
tiles that fall on one place; a transpose turns each tile and its place; a matrix product
joins tiles by the axis that both share and adds the products of one place as they come.

Defined results: elements without a row count as 0, and null elements too; an index occurs
once in an array; array_id is not null; products of arrays whose shared axes differ in
length take the missing part as 0; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = "array_id {kind}, at array<long>, shape array<int>, data array<double>"


def _schema(tiles: DataFrame, column: str = "array_id") -> str:
    return TILE.format(kind=tiles.schema[column].dataType.simpleString())


def _held(data, shape) -> np.ndarray:
    return np.asarray(data, float).reshape([int(x) for x in shape])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["array_id", "at", "shape", "data"])


def from_elements(rows: DataFrame, axes: list[str], value: str, tile: tuple[int, ...], array: str = "array_id") -> DataFrame:
    """Tiles of at most `tile` elements an axis, from one row per element with its index on each axis."""
    size = math.prod(tile)
    held = rows.select(F.col(array).alias("array_id"), F.array(*[F.floor(F.col(a) / n).cast("long") for a, n in zip(axes, tile, strict=True)]).alias("at"), F.array(*[(F.col(a) % n).cast("int") for a, n in zip(axes, tile, strict=True)]).alias("in"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for array_id, at, place, x in zip(batch["array_id"], batch["at"], batch["in"], batch["x"], strict=True):
                place = np.array([np.asarray(p) for p in place], np.int64)
                shape = place.max(0) + 1
                data = np.zeros(shape)
                data[tuple(place.T)] = np.asarray(x, float)
                out.append((array_id, at, shape.tolist(), data.ravel()))
            yield _frame(out)

    if size < 1:
        raise ValueError(f"tiles of {tile}")
    grouped = held.groupBy("array_id", "at").agg(F.collect_list("in").alias("in"), F.collect_list("x").alias("x"))
    return grouped.mapInPandas(run, _schema(held))


def to_elements(tiles: DataFrame, tile: tuple[int, ...]) -> DataFrame:
    """array_id, index (an array, one number an axis), value: a row per element."""
    each = tiles.select("array_id", "at", "shape", F.posexplode("data").alias("p", "value"))
    stride, index = F.lit(1), []
    for axis in range(len(tile) - 1, -1, -1):
        own = F.col("shape")[axis]
        index.insert(0, F.col("at")[axis] * tile[axis] + F.floor(F.col("p") / stride) % own)
        stride = stride * own
    return each.select("array_id", F.array(*[i.cast("long") for i in index]).alias("index"), "value")


def transpose(tiles: DataFrame, axes: tuple[int, ...]) -> DataFrame:
    """Axes in a new order, as numpy's transpose."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for array_id, at, shape, data in zip(*(batch[c] for c in ("array_id", "at", "shape", "data")), strict=True):
                turned = _held(data, shape).transpose(axes)
                out.append((array_id, [int(at[a]) for a in axes], list(turned.shape), turned.ravel()))
            yield _frame(out)

    return tiles.mapInPandas(run, _schema(tiles))


def _added(batches: Iterator[pd.DataFrame], op=np.add) -> Iterator[pd.DataFrame]:
    """Tiles sorted by place: those of one place become one, a tile at a time."""
    key, total = None, None
    for batch in batches:
        out = []
        for array_id, at, shape, data in zip(*(batch[c] for c in ("array_id", "at", "shape", "data")), strict=True):
            own = _held(data, shape)
            if key == (array_id, tuple(at)):
                shape_both = np.maximum(total.shape, own.shape)
                grow = lambda x: np.pad(x, [(0, int(b) - a) for a, b in zip(x.shape, shape_both, strict=True)])
                total = op(grow(total), grow(own)) if op is np.add else op(total, own)
                continue
            if key is not None:
                out.append((key[0], list(key[1]), list(total.shape), total.ravel()))
            key, total = (array_id, tuple(at)), own
        if out:
            yield _frame(out)
    if key is not None:
        yield _frame([(key[0], list(key[1]), list(total.shape), total.ravel())])


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


OPS = {"sum": np.add, "max": np.maximum, "min": np.minimum}


def reduce_axis(tiles: DataFrame, axis: int, op: str = "sum") -> DataFrame:
    """sum, max or min along an axis, which is gone in the result. Ragged tiles (elements
    without a row at a tile's ends) are for sums only."""
    step = OPS[op]

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for array_id, at, shape, data in zip(*(batch[c] for c in ("array_id", "at", "shape", "data")), strict=True):
                less = step.reduce(_held(data, shape), axis=axis)
                out.append((array_id, [int(x) for k, x in enumerate(at) if k != axis], list(np.shape(less)), np.ravel(less)))
            yield _frame(out)

    part = tiles.mapInPandas(within, _schema(tiles)).repartition(_parts(tiles), "array_id", "at").sortWithinPartitions("array_id", "at")
    return part.mapInPandas(lambda b: _added(b, step), _schema(tiles))


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Products of the matrices of one id: the second axis of a with the first of b, in tiles of
    equal size there."""
    left = a.select("array_id", F.col("at")[0].alias("i"), F.col("at")[1].alias("k"), F.col("shape").alias("shape_a"), F.col("data").alias("data_a"))
    right = b.select("array_id", F.col("at")[0].alias("k"), F.col("at")[1].alias("j"), F.col("shape").alias("shape_b"), F.col("data").alias("data_b"))

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for array_id, i, j, shape_a, data_a, shape_b, data_b in zip(*(batch[c] for c in ("array_id", "i", "j", "shape_a", "data_a", "shape_b", "data_b")), strict=True):
                x, y = _held(data_a, shape_a), _held(data_b, shape_b)
                n = min(x.shape[1], y.shape[0])
                z = x[:, :n] @ y[:n]
                out.append((array_id, [i, j], list(z.shape), z.ravel()))
            yield _frame(out)

    pairs = left.join(right, ["array_id", "k"]).mapInPandas(product, _schema(a))
    return pairs.repartition(_parts(a), "array_id", "at").sortWithinPartitions("array_id", "at").mapInPandas(_added, _schema(a))
