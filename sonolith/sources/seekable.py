"""Stored signals with seek, read and append, as a Spark data source named `signal`.

A store is a folder of versions, one an append. A version holds Parquet files in the order
of (signal_id, idx), in small row groups, and an index with a row for each chunk of a
signal in a file: its first and last index, and its rows' place in the file. A read by
signal or by index asks the index, plans the files and row groups that hold the chunks,
and opens nothing else; other filters and the edges of chunks are left to Spark. As a stream,
an offset is a number of versions: a version is read once its index is complete.

Defined results: an index of a signal is written once (appends don't replace samples); a
store that isn't there is an error, one without versions is empty.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "signal_id long, idx long, sample double"
#: Samples of a chunk; bytes of a row group.
CHUNK, GROUP_BYTES = 1 << 14, 1 << 20


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def versions(path: str) -> list[int]:
    """The complete versions of a store, ascending."""
    from pyarrow import fs

    system, root = _opened(path)
    found = system.get_file_info(fs.FileSelector(root))
    names = [x.base_name for x in found if x.type == fs.FileType.Directory and x.base_name.startswith("version=")]
    done = system.get_file_info([f"{root}/{n}/index/_SUCCESS" for n in names])
    return sorted(int(n.partition("=")[2]) for n, x in zip(names, done, strict=True) if x.type == fs.FileType.File)


@dataclass
class Piece(InputPartition):
    """Row ranges (first, rows) of one file; none: the whole file."""

    file: str
    rows: list[tuple[int, int]] | None = None


def _index(path: str, numbers: list[int], signal: int | None, low: int | None, high: int | None):
    """The chunks of some versions that may hold the signal's indices from low to high, inclusive."""
    import pyarrow.compute as pc
    import pyarrow.dataset as ds

    system, root = _opened(path)
    test = pc.scalar(True)
    if signal is not None:
        test = test & (ds.field("signal_id") == signal)
    if low is not None:
        test = test & (ds.field("high") >= low)
    if high is not None:
        test = test & (ds.field("low") <= high)
    for number in numbers:
        folder = f"{root}/version={number}"
        held = ds.dataset(f"{folder}/index", format="parquet", filesystem=system)
        for batch in held.to_batches(columns=["file", "first", "rows"], filter=test):
            for file, first, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield f"{folder}/data/{file}", first, rows


def _files(path: str, numbers: list[int]) -> list[Piece]:
    from pyarrow import fs

    system, root = _opened(path)
    out = []
    for number in numbers:
        found = system.get_file_info(fs.FileSelector(f"{root}/version={number}/data"))
        out += [Piece(x.path) for x in found if x.base_name.endswith(".parquet")]
    return out


def _read(path: str, piece: Piece | None) -> Iterator:
    """Batches of the row groups that hold the piece's rows; none where nothing is planned."""
    import pyarrow.parquet as pq

    if piece is None:
        return
    system, _ = _opened(path)
    with system.open_input_file(piece.file) as held:
        file, first = pq.ParquetFile(held), 0
        for k in range(file.num_row_groups):
            n = file.metadata.row_group(k).num_rows
            wanted = [(0, n)] if piece.rows is None else [(max(0, a - first), min(n, a + m - first)) for a, m in piece.rows if a < first + n and a + m > first]
            if wanted:
                group = file.read_row_group(k, columns=["signal_id", "idx", "sample"])
                for a, b in wanted:
                    yield from group.slice(a, b - a).to_batches()
            first += n


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.signal, self.low, self.high = path, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """The chunks to read follow from filters on signal_id and idx; Spark checks the rows themselves."""
        for f in filters:
            at = getattr(f, "attribute", None)
            if at == ("signal_id",) and isinstance(f, EqualTo):
                self.signal = f.value
            if at == ("idx",):
                if isinstance(f, EqualTo | GreaterThanOrEqual | GreaterThan):
                    value = f.value + isinstance(f, GreaterThan)
                    self.low = value if self.low is None else max(self.low, value)
                if isinstance(f, EqualTo | LessThanOrEqual | LessThan):
                    value = f.value - isinstance(f, LessThan)
                    self.high = value if self.high is None else min(self.high, value)
            yield f

    def partitions(self) -> Sequence[InputPartition]:
        numbers = versions(self.path)
        if self.signal is None and self.low is None and self.high is None:
            return _files(self.path, numbers)
        by: dict[str, list[tuple[int, int]]] = {}
        for file, first, rows in _index(self.path, numbers, self.signal, self.low, self.high):
            by.setdefault(file, []).append((first, rows))
        return [Piece(file, sorted(rows)) for file, rows in by.items()]

    def read(self, partition: Piece | None) -> Iterator:
        return _read(self.path, partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"versions": 0}

    def latestOffset(self) -> dict:
        # Versions are numbered from 0; those behind one that isn't complete wait for it.
        found = versions(self.path)
        return {"versions": next((k for k, v in enumerate(found) if v != k), len(found))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _files(self.path, list(range(start["versions"], end["versions"])))

    def read(self, partition: Piece | None) -> Iterator:
        return _read(self.path, partition)

    def commit(self, end: dict) -> None:
        pass


class SignalSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "signal"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"])


class Store:
    """A stored signal set: append, read, seek, and follow as a stream."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(SignalSource)

    def append(self, rows: DataFrame, version: int, chunk: int = CHUNK, group_bytes: int = GROUP_BYTES) -> None:
        """rows (signal_id, idx, sample) as the next version; a version that is there is an error."""
        home = f"{self.path}/version={version}"
        data = rows.select(F.col("signal_id").cast("long"), F.col("idx").cast("long"), F.col("sample").cast("double"))
        data = data.repartitionByRange("signal_id", "idx").sortWithinPartitions("signal_id", "idx")
        data.write.option("parquet.block.size", group_bytes).parquet(f"{home}/data")
        held = self.spark.read.parquet(f"{home}/data").select("signal_id", "idx", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
        index = held.groupBy("signal_id", F.floor(F.col("idx") / chunk).cast("long").alias("chunk"), "file").agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
        index.repartitionByRange("signal_id", "chunk").sortWithinPartitions("signal_id", "chunk").write.parquet(f"{home}/index")

    def read(self) -> DataFrame:
        return self.spark.read.format("signal").load(self.path)

    def seek(self, start: int, n: int | None = None, signal: int | None = None) -> DataFrame:
        """n samples from index `start` on, or all, of one signal or of each."""
        rows = self.read().where(F.col("idx") >= start)
        if n is not None:
            rows = rows.where(F.col("idx") < start + n)
        return rows if signal is None else rows.where(F.col("signal_id") == signal)

    def follow(self) -> DataFrame:
        """A stream of the versions, those to come included."""
        return self.spark.readStream.format("signal").load(self.path)
