"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word contracts.
BLANKS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a
    temporary one only where it is unset and one machine does all the work (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="sonolith-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stable(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and
    later steps survive lost executors without redoing the work before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Keys that `join_one` broadcasts are fewer than this.
HOT_KEYS = 20_000


def join_one(rows: DataFrame, facts: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """rows joined with facts, a stored table of one row a key, where `count` is the number
    of rows that hold the key, and total that of all rows.

    A key held by more than 1 / HOT_KEYS of the rows is one of fewer than HOT_KEYS, so
    these are broadcast and their rows stay where they are; the others are shuffled.
    """
    many = F.col(count) > max(4096, total // HOT_KEYS)
    hot = facts.where(many)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(facts.where(~many), key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def columns(df: DataFrame) -> list[Column]:
    """All columns by their exact names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of fewer texts for this session: Python workers hold a batch in
    full, and texts may be long. A smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def whole(text: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; null ids give null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


#: Bits of a map that is collected and broadcast, whatever the data: 8 MB.
BITMAP = 1 << 26


def bitmap(slots: DataFrame) -> np.ndarray:
    """The bits at the numbers in `slot`, each from 0 up to BITMAP, as bytes."""
    maps = slots.groupBy(F.expr("slot div 32768").alias("b")).agg(F.expr("bitmap_construct_agg(slot % 32768)").alias("m"))
    bits = np.zeros(BITMAP // 8, np.uint8)
    for r in maps.toLocalIterator():  # BITMAP / 32768 rows of 4 KB at most
        bits[r["b"] * 4096 : (r["b"] + 1) * 4096] = np.frombuffer(bytes(r["m"]), np.uint8)
    return bits


def has_bit(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(BITMAP - 1)
    return (bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
