"""Mix sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

1. Each source gets its weight's share of all words, at most ``max_epochs`` times its own size; what is above is shared
   again by weight. The level is found in one pass over the sources in the order in which they reach their limit.
2. The mix is cut into equal blocks, small enough that the least target has many of them: ``block_words`` words at most,
   one word if need be. Blocks go to sources by the highest quotients target / (2k + 1).
   A source's count cannot leave a small interval around its quota, so only quotients inside it are ranked.
3. The blocks of a source go to its shards in the same way, by shard size. A source has as many shards as its size
   asks for, so a source with a third of all words is spread like any other. What a shard's blocks have above
   ``max_epochs`` times its words goes to the source's next shards that have room.
4. Inside a shard the documents stand in a seeded order, and the shard takes its blocks from a seeded place on, around
   the shard as often as needed. What a document gives is the overlap of its words with that run.

Per-source rows are the only ones that meet in one task; documents are windowed by shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import written

WORD = r"[^\x20\x09-\x0D]+"
#: Up to so many sources, of a name and a number each, are sent to all tasks; more are joined by shuffle.
FEW_SOURCES = 10_000
#: Of a source: no name (sorts last), and its name.
SOURCE = ["no_source", "source_name"]


def words(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(source, source_size) with ``target``: the source's share of all words."""
    place = F.row_number().over(Window.orderBy(*SOURCE)) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    by_limit = Window.orderBy("limit_per_weight", *SOURCE)
    before, after = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("limit", (F.col("source_size") * max_epochs).cast("double"))
        .withColumn("limit_per_weight", F.col("limit") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.min(F.when(F.col("level") < F.col("limit_per_weight"), F.struct("limit_per_weight", *SOURCE, "level"))).over(all_rows)["level"])
    )
    target = F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit"))
    return ranked.select(*SOURCE, "source_size", target.alias("target"))


def apportion(parties: DataFrame, group: list[str], names: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Append ``out``: the seats of each party by the highest quotients votes / (2k + 1), ties by ``names``.

    The divisor that gives the right total lies so near to votes / seats that a party's seats differ from its quota
    by at most its share of half the number of parties, and one half for rounding.
    """
    g = Window.partitionBy(*group)
    quota = F.col(votes) / F.col("all_votes") * F.col(seats)
    slack = F.col(votes) / F.col("all_votes") * F.col("parties") / 2
    bounded = (
        parties.withColumn("all_votes", F.sum(votes).over(g).cast("double"))
        .withColumn("parties", F.count(F.lit(1)).over(g))
        .withColumn("low", F.when((F.col("all_votes") > 0) & (F.col(votes) > 0), F.greatest(F.lit(0).cast("long"), F.floor(quota - slack) - 2)).otherwise(F.lit(0).cast("long")))
        .withColumn("high", F.when((F.col("all_votes") > 0) & (F.col(votes) > 0), F.ceil(quota + slack) + 2).otherwise(F.lit(-1).cast("long")))
        .withColumn("open_seats", F.col(seats) - F.sum("low").over(g))
    )
    order = Window.partitionBy(*group).orderBy(F.desc("quotient"), *names)
    won = (
        bounded.filter("high >= low").select(*group, *names, "low", "open_seats", F.col(votes).alias("v"), F.explode(F.sequence("low", "high")).alias("k"))
        .withColumn("quotient", F.col("v") / (F.col("k") * 2 + 1))
        .withColumn("rank", F.row_number().over(order))
        .groupBy(*group, *names)
        .agg(F.max(F.col("low") + 0).alias("low"), F.sum((F.col("rank") <= F.col("open_seats")).cast("long")).alias("won"))
        .select(*group, *names, (F.col("low") + F.col("won")).alias(out))
    )
    return parties.join(won, [*group, *names], "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    max_epochs: int = 3,
    block_words: int = 64,
    least_blocks: int = 64,
    shard_words: int = 200_000,
    seed: int = 17,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """One row per document: ``row`` (all its columns), ``size``, ``source_size``, ``target`` and ``taken``.

    Sources stand in order of code points, null last, and weigh ``weights`` in turn. A null or empty text has no words
    and gives none; without any words all targets are 0; an empty table gives an empty result. Equal ids are told
    apart by size and text, so repeated rows are interchangeable. Reruns agree, whatever the partitions.
    """
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    sized = docs.select(
        F.struct("*").alias("row"),
        F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source), F.lit("")).alias("source_name"),
        words(F.col(text)).alias("size"),
        F.conv(F.substring(mark, 1, 8), 16, 10).cast("long").alias("lot"),
        F.substring(mark, 9, 24).alias("turn"),
        F.md5(F.coalesce(F.col(text), F.lit(""))).alias("body"),
        F.col(key).alias("id"),
    )
    sizes = sized.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs)
    total = F.sum("source_size").over(Window.partitionBy())
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy())
    block = F.greatest(F.lit(1).cast("long"), F.least(F.lit(block_words).cast("long"), F.floor(least / least_blocks)))
    targets = targets.withColumn("block", block).withColumn("mix_blocks", F.floor(total / F.col("block"))).withColumn("one", F.lit(1))
    targets = apportion(targets, ["one"], SOURCE, "target", "mix_blocks", "blocks")
    targets = targets.select(*SOURCE, "source_size", "target", "block", "blocks", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_words)).alias("shards"))

    targets = written(targets, "mix-sources")
    shards_of = targets.select(*SOURCE, "shards")
    shards_of = F.broadcast(shards_of) if targets.count() <= FEW_SOURCES else shards_of
    placed = sized.join(shards_of, SOURCE).withColumn("shard", F.col("lot") % F.col("shards")).drop("shards", "lot")
    shard = [*SOURCE, "shard"]
    shards = placed.groupBy(*shard).agg(F.sum("size").alias("shard_size")).join(targets, SOURCE)
    shards = apportion(shards, SOURCE, ["shard"], "shard_size", "blocks", "quota")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "source_name", F.lit(":"), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("long")
    zero = F.lit(0).cast("long")
    asked, most, whole = F.col("quota") * F.col("block"), F.col("shard_size") * max_epochs, Window.partitionBy(*SOURCE)
    shards = shards.withColumn("room", F.greatest(zero, most - asked)).withColumn("above", F.sum(F.greatest(zero, asked - most)).over(whole))
    before = F.coalesce(F.sum("room").over(whole.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), zero)
    shards = shards.withColumn("run", F.least(asked, most) + F.least("room", F.greatest(zero, F.col("above") - before)))
    shards = shards.select(
        *shard, "source_size", "target", "shard_size", "run",
        F.when(F.col("shard_size") > 0, start % F.col("shard_size")).otherwise(F.lit(0)).alias("start"),
    )
    order = Window.partitionBy(*shard).orderBy("turn", "id", "size", "body").rowsBetween(Window.unboundedPreceding, 0)
    ended = placed.withColumn("end", F.sum("size").over(order)).join(shards, shard)

    rest = F.when(F.col("shard_size") > 0, F.col("run") % F.col("shard_size")).otherwise(F.lit(0))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("run") / F.col("shard_size"))).otherwise(F.lit(0))
    last = F.col("start") + rest

    def covered(x: Column) -> Column:
        """Words of the shard's first ``x`` that the last, partial round takes."""
        return F.greatest(zero, F.least(x, last) - F.col("start")) + F.greatest(zero, F.least(x, last - F.col("shard_size")))

    taken = rounds * F.col("size") + covered(F.col("end")) - covered(F.col("end") - F.col("size"))
    return ended.select("row", "size", "source_size", "target", taken.cast("long").alias("taken"))
