"""Shared folder, written tables, and slices of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a task works on at once; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000
#: Setting (from Spark 4.1 on) by which a query removes its shuffle files when it ends; else they wait for the driver's garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, from ``spark.checkpoint.dir``.

    Only a local session may lack the setting, as in tests; it then gets a folder of its own and keeps it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        root = tempfile.mkdtemp(prefix="tidepanel-llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from what was written.

    Later steps read the table, so a lost executor costs one read and no step sees two versions of a row. With ``tidy``
    the shuffle files of the step go with it.
    """
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true" if tidy else before)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_fields(schema: StructType, *fields: StructField) -> StructType:
    """``schema`` with ``fields`` at its end; a field of the same name in ``schema`` gives way."""
    names = {f.name.lower() for f in fields}
    return StructType([f for f in schema.fields if f.name.lower() not in names] + list(fields))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds at most ``limit`` bytes of ``column``, or a single row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def held_out() -> F.col:
    """True for the documents whose label no model may learn from: crc32 of the id as text, modulo 3, is 1.

    A null id counts as held out, so that nothing is learnt from it.
    """
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


#: Stands for every character that is no letter.
EDGE = 1
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or ``EDGE`` if it is no letter."""
    out = np.full(0x110000, EDGE, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            out[code] = ord(low[0]) if len(low) == 1 else code
    return out


def letters(texts: list[str], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with ``gap`` edges before, between and after them, and where each text ends."""
    line = "\n" * gap
    raw = np.frombuffer((line + line.join(texts) + line).encode("utf-32-le", "surrogatepass"), np.uint32)
    return _letters()[raw], np.cumsum([gap + len(t) for t in texts])


class Runs:
    """Hashes of any runs of a sequence of codes, in constant time each."""

    def __init__(self, codes: np.ndarray):
        with np.errstate(over="ignore"):
            powers = lambda base: np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(codes), base)]), dtype=np.uint64)
            self.back = powers(INVERSE)
            self.total = np.concatenate([[np.uint64(0)], np.cumsum(codes.astype(np.uint64) * powers(MULTIPLIER)[:-1], dtype=np.uint64)])

    def __call__(self, start, size) -> np.ndarray:
        return (self.total[start + size] - self.total[start]) * self.back[start]

    def every(self, n: int) -> np.ndarray:
        """Of all runs of ``n`` codes."""
        return (self.total[n:] - self.total[:-n]) * self.back[: len(self.back) - n]


def bucket(hashes: np.ndarray, n: int, bits: int) -> np.ndarray:
    return (((hashes * MULTIPLIER + np.uint64(n)) * MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)
