"""Registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import bpe, centroids, dedup, langid, licences, mixing, packing, repeats, simhash, spelling, syncmers, toxicity, wrapper
from tidepanel.llm.common import documents, held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def tokenizer_files() -> tuple[str, str]:
    """Rank file and split pattern of the installed byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op10_bpe")
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = tokenizer_files()
    coded = bpe.encode(documents(spark, sf_dir, "doc_id", "text"), path, pattern).drop("text")
    return bpe.decode(coded, path, pattern).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query(
    "op3_exact_dedup",
    """
    WITH t AS (
        SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
        FROM documents
    ), r AS (
        SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
            first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
            row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS place
        FROM t
    )
    SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
    """,
)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = dedup.exact_dedup(documents(spark, sf_dir, "doc_id", "text"))
    return done.select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def _apportioned(parties: str, group: str, names: str, votes: str, seats: str, out: str) -> str:
    """SQL of mixing.apportion."""
    by = f"PARTITION BY {group}"
    return f"""(
        SELECT p.*, coalesce(won.seats_won, 0)::BIGINT AS {out} FROM {parties} p LEFT JOIN (
            SELECT {group}, {names}, max(low) + sum((place <= open_seats)::INT) AS seats_won FROM (
                SELECT *, row_number() OVER ({by} ORDER BY v / (k * 2 + 1) DESC, {names}) AS place FROM (
                    SELECT {group}, {names}, v, low, seats - sum(low) OVER ({by}) AS open_seats, unnest(CASE WHEN v > 0 THEN range(low, high + 1) ELSE [] END) AS k FROM (
                        SELECT *, CASE WHEN v > 0 THEN greatest(0, floor(v / all_v * seats - v / all_v * parties / 2)::BIGINT - 2) ELSE 0 END AS low,
                            CASE WHEN v > 0 THEN ceil(v / all_v * seats + v / all_v * parties / 2)::BIGINT + 2 ELSE -1 END AS high FROM (
                            SELECT {group}, {names}, {votes}::DOUBLE AS v, {seats} AS seats, (sum({votes}) OVER ({by}))::DOUBLE AS all_v, count(*) OVER ({by}) AS parties FROM {parties}
                        )
                    )
                )
            ) GROUP BY {group}, {names}
        ) won USING ({group}, {names})
    )"""


@query(
    "op6_mix_sources",
    f"""
    WITH sized AS (
        SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS source_name, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
            md5('17:' || coalesce(doc_id::VARCHAR, '')) AS mark, md5(coalesce(text, '')) AS body
        FROM documents
    ), sizes AS (
        SELECT 1 AS one, no_source, source_name, sum(size)::BIGINT AS source_size FROM sized GROUP BY ALL
    ), ranked AS (
        SELECT *, source_size * 3.0::DOUBLE AS lim, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY no_source, source_name) - 1) % 3 + 1)::INT] AS weight, (sum(source_size) OVER ())::DOUBLE AS total FROM sizes
    ), levels AS (
        SELECT *, lim / weight AS reach, (total - coalesce(sum(lim) OVER (ORDER BY lim / weight, no_source, source_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY lim / weight, no_source, source_name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM ranked
    ), targets AS (
        SELECT one, no_source, source_name, source_size, least(lim, (SELECT l2.lev FROM levels l2 WHERE l2.lev < l2.reach ORDER BY reach, no_source, source_name LIMIT 1) * weight) AS target,
            total, greatest(1, ceil(source_size / 200000.0::DOUBLE))::BIGINT AS shards FROM levels
    ), cut AS (
        SELECT *, greatest(1, least(64, floor(min(target) FILTER (target > 0) OVER () / 64)))::BIGINT AS block FROM targets
    ), dealing AS (
        SELECT *, floor(total / block)::BIGINT AS mix_blocks FROM cut
    ), blocks AS {_apportioned("dealing", "one", "no_source, source_name", "target", "mix_blocks", "blocks")}, placed AS (
        SELECT s.*, ('0x' || substr(mark, 1, 8))::BIGINT % shards AS shard, substr(mark, 9) AS turn FROM sized s JOIN targets USING (no_source, source_name)
    ), cells AS (
        SELECT no_source, source_name, shard, any_value(b.source_size) AS source_size, any_value(b.target) AS target, any_value(b.block) AS block, any_value(b.blocks) AS blocks, sum(size)::BIGINT AS shard_size
        FROM placed JOIN blocks b USING (no_source, source_name) GROUP BY ALL
    ), quotas AS {_apportioned("cells", "no_source, source_name", "shard", "shard_size", "blocks", "quota")}, rooms AS (
        SELECT *, greatest(0, shard_size * 3 - quota * block) AS room, sum(greatest(0, quota * block - shard_size * 3)) OVER (PARTITION BY no_source, source_name) AS above FROM quotas
    ), runs AS (
        SELECT *, least(quota * block, shard_size * 3) + least(room, greatest(0, above - coalesce(sum(room) OVER (PARTITION BY no_source, source_name ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS run, ('0x' || substr(md5('17:' || source_name || ':' || shard::VARCHAR), 1, 8))::BIGINT % shard_size AS start FROM rooms WHERE shard_size > 0
    ), ended AS (
        SELECT p.*, sum(size) OVER (PARTITION BY no_source, source_name, shard ORDER BY turn, doc_id, size, body ROWS UNBOUNDED PRECEDING)::BIGINT AS fin FROM placed p
    ), joined AS (
        SELECT e.doc_id, e.size, e.fin, c.source_size, c.target, c.shard_size, r.run // r.shard_size AS rounds, r.start, r.start + r.run % r.shard_size AS last
        FROM ended e JOIN cells c USING (no_source, source_name, shard) LEFT JOIN runs r USING (no_source, source_name, shard)
    )
    SELECT doc_id, size, source_size, target, coalesce(rounds * size + greatest(0, least(fin, last) - start) + greatest(0, least(fin, last - shard_size))
        - greatest(0, least(fin - size, last) - start) - greatest(0, least(fin - size, last - shard_size)), 0)::BIGINT AS taken
    FROM joined
    """,
)
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir, "doc_id", "source", "text"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", "taken")


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text"))
    return linked.select(F.col("row.doc_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    named = langid.identify(docs.select("doc_id", "text"), docs.filter(~held_out()))
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: A document is called toxic from this score on.
TOXIC = 0.7


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(docs.filter(~held_out()), labels)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


@query("op8_fingerprints")
def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir, "doc_id", "text").select(F.col("doc_id").alias("id"), text.alias("text"), F.xxhash64(text).alias("body"))
    chained = syncmers.with_next(syncmers.with_anchors(docs, "text", "anchors"), ["text", "anchors"])
    n, moved = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - moved), F.substring(F.col("next_text"), F.lit(1), moved))
    both = syncmers.with_anchors(chained.withColumn("n_chars", n.cast("long")).withColumn("edited", edited), "edited", "edited_anchors")
    return both.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        dedup.sha256(F.col("edited")).alias("edited_sha256"),
        syncmers.fingerprint(F.col("anchors")).alias("fingerprint"),
        syncmers.fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        syncmers.likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        syncmers.likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


@query("op2_licences")
def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: paragraphs, those with a confirmed licence, predictions that no template confirms, families."""
    docs = documents(spark, sf_dir, "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    # All paragraphs of a document are in one task, where they are counted; a filter on the prediction would be pushed
    # below it and run the whole classifier once more for every use.
    found = licences.scan(docs).select("row", "doc_id", "family", "probability", "confirmed")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    licensed = F.col("confirmed")
    return found.groupBy("row", "doc_id").agg(
        F.count(F.lit(1)).alias("n_paragraphs"),
        count(licensed).alias("n_licences"),
        count((F.col("family") != licences.UNKNOWN) & ~licensed).alias("n_unconfirmed"),
        F.array_join(F.array_sort(F.collect_set(F.when(licensed, F.col("family")))), ",").alias("families"),
        F.max(F.when(licensed, F.col("probability"))).alias("probability"),
    ).drop("row")


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.cut_repeats(documents(spark, sf_dir, "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return cut.select(
        F.col("row.doc_id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query("op5_main_text")
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return wrapper.main_text(pages).select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def _rounds_sql(k: int, rounds: int) -> str:
    """SQL of centroids.cluster: every round one table of centroids and one of vectors beside their nearest."""
    near = """n{i} AS MATERIALIZED (SELECT row_id, vec_id, v, min(d) AS d, arg_min(c, (d, c)) AS c FROM (
        SELECT f.*, c.c, list_sum(list_transform(generate_series(1, 64), lambda j: (f.v[j] - c.m[j]) * (f.v[j] - c.m[j])))::BIGINT AS d FROM f, c{i} c) GROUP BY ALL)"""
    move = """c{j} AS MATERIALIZED (SELECT c{i}.c, coalesce(q.m, c{i}.m) AS m FROM c{i} LEFT JOIN (
        SELECT c, list(floored ORDER BY j) AS m FROM (
            SELECT c, j, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS floored FROM (
                SELECT c, unnest(v) AS x, unnest(generate_series(1, 64)) AS j FROM n{i}) GROUP BY c, j) GROUP BY c) q USING (c))"""
    steps = [near.format(i=0)]
    for i in range(rounds):
        steps += [move.format(i=i, j=i + 1), near.format(i=i + 1)]
    return f"""WITH f AS MATERIALIZED (
        SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    ), c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY mark, v) - 1 AS c, v AS m FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS mark, v FROM f ORDER BY mark, v LIMIT {k})
    ), {", ".join(steps)}
    SELECT vec_id, c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
        sha256(array_to_string(m, ',')) AS centroid_sha256 FROM n{rounds} JOIN c{rounds} USING (c)"""


@query("op12_centroids", _rounds_sql(40, 5))
def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    placed, found = centroids.cluster(vectors, k=40, rounds=5)
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    # found has one row per centroid, 40 at most
    both = placed.join(F.broadcast(found.select("cluster", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))), "cluster")
    return both.select("row.vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


#: Occurrences of a word from which it takes part.
LEAST_N = 3


@query("op13_spelling")
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = spelling.count_words(documents(spark, sf_dir, "doc_id", "text"), 5, spelling.misspelt)
    return spelling.variants(counts.filter(F.col("n") >= LEAST_N)).select("word", "form", "root", "n", "n_near", "form_n")


@query("op11_packing")
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    cut = packing.pieces(documents(spark, sf_dir, "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    packed = packing.pack(cut)
    return packed.select("row.doc_id", "row.piece", "row.start", "length", "row.ids_crc32", "sequence_id", "offset")
