"""Document fingerprints from closed syncmers.

The symbols of a text are its words, cut after every ``PIECE`` characters. A run of ``K`` symbols is an anchor when,
of the runs of ``S`` symbols inside it, the one with the least hash lies at its start or at its end. That depends on
the run alone, so equal passages of two texts have equal anchors, whatever stands around them. A fingerprint is the
list of a text's anchors in order; likeness is the share of anchors that two fingerprints have in common.

Everything is built-in array expressions. Neighbouring documents are found in ranges of ids; each range also gets a
copy of the row that follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE, K, S = 8, 6, 2
SYMBOL = rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"


def with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """Append ``out``, the anchors of the whole ``text`` as array<int> in order.

    A null text, or one of white space, has none. Of a text with fewer than ``K`` symbols, each is an anchor.
    """
    window = K - S + 1
    tail = lambda c, n, size: F.slice(F.col(c), n + 1, size)
    zero = F.lit(0)
    size = F.greatest(zero, F.col("_n") - K + 1)
    df = df.withColumn("_symbols", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(SYMBOL), F.lit(0)))
    df = df.withColumn("_n", F.size("_symbols")).withColumn("_hash", F.transform("_symbols", lambda x: F.xxhash64(x)))
    pairs = F.greatest(zero, F.col("_n") - 1)
    df = df.withColumn("_inner", F.zip_with(tail("_hash", 0, pairs), tail("_hash", 1, pairs), lambda a, b: F.xxhash64(a, b)))
    two = F.greatest(zero, F.col("_n") - 2)
    df = df.withColumn("_two", F.zip_with(tail("_inner", 0, two), tail("_inner", 1, two), lambda a, b: F.least(a, b)))
    four = F.greatest(zero, F.col("_n") - 4)
    df = df.withColumn("_four", F.zip_with(tail("_two", 0, four), tail("_two", 2, four), lambda a, b: F.least(a, b)))
    parts = F.arrays_zip(
        tail("_four", 0, size).alias("low"), tail("_inner", 0, size).alias("first"), tail("_inner", S, size).alias("middle"), tail("_inner", window - 1, size).alias("last")
    )
    few = F.transform("_hash", lambda h: F.shiftright(h, 32).cast("int"))

    def anchor(r: Column) -> Column:
        low = F.least(r["low"], r["last"])
        return F.when((low == r["first"]) | (low == r["last"]), F.shiftright(F.xxhash64(r["first"], r["middle"], r["last"]), 32).cast("int"))

    found = F.filter(F.transform(parts, anchor), lambda x: x.isNotNull())
    df = df.withColumn(out, F.when(F.col("_n") >= K, found).otherwise(few))
    return df.drop("_symbols", "_n", "_hash", "_inner", "_two", "_four")


def fingerprint(anchors: Column) -> Column:
    """The anchors as one string, eight hexadecimal digits each."""
    return F.lower(F.array_join(F.transform(anchors, lambda x: F.right(F.hex(x.cast("long") + F.lit(1 << 32)), F.lit(8))), ""))


def likeness(a: Column, b: Column) -> Column:
    """Common anchors over all anchors of both, 0 to 1; two texts without anchors are alike."""
    together = F.size(F.array_union(a, b))
    return F.when(together == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / together)


def _range_starts(ids: DataFrame, parts: int) -> list:
    """The first (id, body) of each range of rows in order of id, at most ``parts`` of them; null ids are not ranged."""
    ranged = ids.filter("id is not null").repartitionByRange(parts, "id", "body").groupBy(F.spark_partition_id()).agg(F.min(F.struct("id", "body")).alias("start"))
    return sorted((tuple(r["start"]) for r in ranged.collect()), key=lambda x: x)


def with_next(docs: DataFrame, values: list[str], parts: int | None = None, id: str = "id", body: str = "body") -> DataFrame:
    """Append ``next_<value>`` of the following row in order of (id, body), null ids first; the last is followed by the first.

    Rows with the same id and text stay in one range; the number of ranges is the number of shuffle partitions.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select("id", "body")
    starts: list = [(None, ids.filter("id is null").agg(F.min("body")).first()[0])] + _range_starts(ids, parts)
    kind = docs.schema["id"].dataType
    lit = lambda values, to: F.array(*(F.lit(v).cast(to) for v in values)).cast(f"array<{to}>")
    id_type = kind.simpleString()
    first_ids, first_bodies = [s[0] for s in starts[1:]], [s[1] for s in starts]
    step = max(1, int(len(first_ids) ** 0.5))
    low = lambda array, body_: F.filter(array, lambda s: (s["id"] < F.col("id")) | ((s["id"] == F.col("id")) & (s["body"] <= F.col("body"))))  # noqa: E731, ARG005
    pairs = F.arrays_zip(lit(first_ids, id_type).alias("id"), lit(first_bodies[1:], "bigint").alias("body"))
    coarse = F.arrays_zip(lit(first_ids[::step], id_type).alias("id"), lit(first_bodies[1::step], "bigint").alias("body"))
    block = F.size(low(coarse, None))
    fine = F.size(low(F.slice(pairs, F.greatest(F.lit(1), (F.col("_block") - 1) * step + 1), step), None))
    # range 0 holds the null ids
    ranged = docs.withColumn("_block", F.when(F.col("id").isNull(), 0).otherwise(block))
    ranged = ranged.withColumn("_range", F.when(F.col("_block") == 0, 0).otherwise((F.col("_block") - 1) * step + fine)).drop("_block")
    before = [0] * len(starts)
    used = [i for i, s in enumerate(starts) if s[1] is not None]
    for k, i in enumerate(used):
        before[i] = used[k - 1]
    own = F.struct(F.col("_range").alias("range"), F.lit(False).alias("guest"))
    ahead = F.struct(F.element_at(lit(before, "int"), F.col("_range") + 1).alias("range"), F.lit(True).alias("guest"))
    opens = (F.element_at(lit(first_bodies, "bigint"), F.col("_range") + 1) == F.col("body")) & F.col("id").eqNullSafe(F.element_at(lit([None, *first_ids], id_type), F.col("_range") + 1))
    dealt = ranged.withColumn("_place", F.explode(F.when(opens, F.array(own, ahead)).otherwise(F.array(own)))).withColumn("_range", F.col("_place.range"))
    order = Window.partitionBy("_range").orderBy("_place.guest", "id", "body")
    for v in values:
        dealt = dealt.withColumn(f"next_{v}", F.lead(v).over(order))
    return dealt.filter(~F.col("_place.guest")).drop("_place", "_range")
