"""Exact deduplication by a stream with keyed state.

Rows pass once through a stream whose state, kept by RocksDB on disk and never expired, holds for each digest of the
normalised text how many rows had it, and the stable id and the place (``at``, the number of the row in the staged
table) of the row that stays. The state is then read as a table. Every digest that was hit more than once is checked
on the full bytes of its rows; a digest shared by different texts is grouped again by the bytes themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import new_path, written

#: The state lives on disk. Many small stores need not reserve space ahead, and a batch saves its changes only.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def normalised(text: Column) -> Column:
    """``text`` without the characters space and U+0009 to U+000D; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for code in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
        out = F.replace(out, F.lit(chr(code)), F.lit(""))
    return out


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


#: Of equal texts the least of these stays: most code points, smallest id (null last), first staged row.
RANK = ("minus_n", "no_id", "id", "at")


def _stage(docs: DataFrame, text: str, key: str, digest) -> DataFrame:
    norm = normalised(F.col(text))
    return written(
        docs.select(
            F.struct("*").alias("row"),
            F.col(key).alias("id"),
            F.col(key).isNull().alias("no_id"),
            (-F.length(F.coalesce(F.col(text), F.lit("")))).alias("minus_n"),
            digest(norm).alias("digest"),
            F.monotonically_increasing_id().alias("at"),
        ),
        "dedup-rows",
    )


def _state(staged: DataFrame, files_per_batch: int) -> DataFrame:
    """(digest, group_size, keep) after the whole table has passed through the stream."""
    spark = staged.sparkSession
    folder = new_path(spark, "dedup-state")
    rows = spark.readStream.schema(staged.schema).option("maxFilesPerTrigger", files_per_batch).parquet(_path(staged))
    state = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(*RANK)).alias("keep"))
    before = {name: spark.conf.get(name, None) for name in STATE_CONF}
    for name, value in STATE_CONF.items():
        spark.conf.set(name, value)
    try:
        stream = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    stream.awaitTermination()
    held = spark.read.format("statestore").load(folder).select("key.*", "value.*")
    names = ["digest", "group_size", "keep"]
    return held.toDF(*names).withColumn("digest", F.col("digest").cast("string"))


def _path(staged: DataFrame) -> str:
    """Folder of a written table."""
    return staged.select(F.input_file_name().alias("f")).first()["f"].rsplit("/", 1)[0]


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", files_per_batch: int = 1000, digest=sha256) -> DataFrame:
    """One row per row of ``docs``: ``row`` (all its columns), ``keep_id``, ``group_size``, ``kept`` and ``digest``.

    A null text counts as empty; all empty texts are equal. Repeated rows are a group of which one stays; a null id
    ranks last. An empty table gives an empty result. Other columns only travel inside ``row``, so their names never
    clash. ``digest`` turns a normalised text into a string; it may collide, the result does not depend on it.
    """
    staged = _stage(docs, text, key, digest)
    empty = staged.limit(0).select("row", F.col("id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    if staged.isEmpty():
        return empty
    state = _state(staged, files_per_batch)
    hits = staged.join(state.filter("group_size > 1").select("digest"), "digest", "left_semi")
    by_bytes = hits.withColumn("bytes", normalised(F.col("row")[text])).groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"))
    mixed = written(by_bytes.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("digest"), "dedup-mixed")
    out = staged.select("row", "digest", "at")
    collided = None
    if not mixed.isEmpty():
        rows = staged.join(mixed, "digest", "left_semi").withColumn("bytes", normalised(F.col("row")[text]))
        groups = rows.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(*RANK)).alias("keep"))
        collided = rows.select("row", "digest", "at", "bytes").join(groups, ["digest", "bytes"]).drop("bytes")
        out, state = (df.join(mixed, "digest", "left_anti") for df in (out, state))
    out = out.join(state, "digest")
    out = out.unionByName(collided) if collided is not None else out
    return out.select("row", F.col("keep.id").alias("keep_id"), "group_size", (F.col("at") == F.col("keep.at")).alias("kept"), "digest")
