"""What the operators share: words, hashes, bounded memos, Arrow mapping and intermediate tables."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.lineage import discard, shared_folder

#: A word is a longest run of other characters than these six; bytes.split() without arguments cuts at the same ones.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

U64 = np.uint64
_MUL1, _MUL2, _MUL3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


class Scratch:
    """Intermediate tables of one call in a folder that driver and executors share; they cut the lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.parts = spark, shared_folder(spark), 0

    def path(self, name: str) -> str:
        self.parts += 1
        return f"{self.folder}/{self.parts}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The rows, written and read again."""
        path = self.path(name)
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.stored = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that nothing is read from any more."""
        for t in tables:
            discard(self.spark, t.stored)


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """The rows as a table of a folder of its own, which stays until the session ends."""
    return Scratch(df.sparkSession).write(df, name)


class Memo(dict):
    """Remembers fn by key. It holds two generations of half of `limit` entries each: what is asked for again moves to the newer, the rest goes with the older. So its
    memory is bounded, and rare keys do not drive out frequent ones."""

    def __init__(self, fn: Callable, limit: int = 60_000):
        super().__init__()
        self.fn, self.half, self.older = fn, limit // 2, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.fn(key)
        if len(key) <= 64:
            if len(self) >= self.half:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


#: The setting of Arrow batches' size, and Spark's default, which takes 64 MB for each task on either side, and as much again for what is made of it.
BATCH_BYTES, DEFAULT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """The rows, in a session whose Arrow batches have 16 MB at most unless it has a size of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_BYTES) == DEFAULT_BYTES:
        conf.set(BATCH_BYTES, "16m")
    return df


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, object]]], schema: str, rows: int = 512) -> DataFrame:
    """Calls what make() returns (made once per task) with the columns of up to `rows` rows as lists; it gives the columns of its result."""
    names = [x.strip().split()[0] for x in _fields(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = step({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x) for x in (out[n] for n in names)], names)
            size = batch.nbytes
            batch = part = None
            release(size)

    return small_batches(df).mapInArrow(run, schema)


def release(size: int) -> None:
    """After a batch of some size: gives back to the system what Arrow holds no more, so that idle workers are small."""
    if size > 1 << 20:
        pa.default_memory_pool().release_unused()


def _fields(schema: str) -> Iterable[str]:
    depth, last = 0, 0
    for i, c in enumerate(schema):
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            yield schema[last:i]
            last = i + 1
    yield schema[last:]


def hash64(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of 64-bit hashes, element by element."""
    h = (a * _MUL1) ^ (b * _MUL2 + _MUL3)
    h ^= h >> U64(29)
    h *= _MUL1
    h ^= h >> U64(32)
    h *= _MUL2
    h ^= h >> U64(29)
    return h


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
