"""Helpers that several operators of this folder share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: The six ASCII characters that separate words, as they stand in a regex class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"

#: A side of a join is broadcast only while its rows have at most this many bytes;
#: beyond, the same join runs as a shuffle join.
BROADCAST_BYTES = 32_000_000


_opened: list[list[Scratch]] = []


@contextlib.contextmanager
def scratch_closed() -> Iterator[None]:
    """Remove what operators inside wrote for themselves, once their results are written."""
    _opened.append([])
    try:
        yield
    finally:
        for made in _opened.pop():
            made.close()


class Scratch:
    """Intermediate tables in the folder all executors share.

    ``spark.checkpoint.dir`` names that folder; where it is unset, only a session on one
    machine may fall back on ``/tmp/checkpoints``. A written table cuts the lineage, so a lost
    executor costs the running stage only. The tables of a run lie in one folder;
    `drop` removes those that no later step reads. What a lazy result still reads goes with
    `close`, after the result is written.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "/tmp/checkpoints"
        self.path = f"{base.rstrip('/')}/emberlog/{name}-{uuid.uuid4().hex}"
        self._n = 0
        if _opened:
            _opened[-1].append(self)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        self._n += 1
        return f"{self.path}/{self._n}-{name}"

    def _delete(self, path: str) -> None:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        found.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(found, True)

    def close(self) -> None:
        """Remove all tables of the run."""
        self._delete(self.path)

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            parents = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
            for parent in parents:
                if "/emberlog/" not in parent:
                    raise ValueError(f"not a scratch table: {parent}")
                self._delete(parent)


def sized(df: DataFrame, rows: int, width: int = 32) -> DataFrame:
    """df with a broadcast hint if its counted rows of `width` bytes each are within BROADCAST_BYTES."""
    return F.broadcast(df) if rows * width <= BROADCAST_BYTES else df


#: The most keys that `join_frequent` broadcasts.
HOT_KEYS = 100_000


def join_frequent(big: DataFrame, small: DataFrame, on: list[str], rows: int, count: str) -> DataFrame:
    """big joined (inner) with small, whose column `count` is at most the number of big's rows of its key.

    Keys of more than 1 / HOT_KEYS of the `rows` of big are at most HOT_KEYS by arithmetic: they
    are broadcast, and big's rows stay where they are. The others meet in a shuffle join, none with
    more than that share of the rows.
    """
    limit = rows // HOT_KEYS
    hot = small.where(F.col(count) > limit)
    if not limit:
        return big.join(F.broadcast(hot), on)
    cold = big.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.where(F.col(count) <= limit), on)
    return big.join(F.broadcast(hot), on).unionByName(cold)


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than SPACE_CLASS; null: none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, SPACE_CLASS + "+")
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: a bijection on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def list_array(values: np.ndarray, lengths, kind: pa.DataType) -> pa.Array:
    """An Arrow list array over a flat numpy array."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
