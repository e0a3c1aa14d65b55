"""Nulls, empty, long and repeated rows, empty tables and clashing columns for every operator and pipeline stage."""

import hashlib

import pytest

import corpus_pipeline
from tidepanel.llm import bpe, dedup, langid, licences, mixing, repeats, simhash, syncmers, toxicity, wrapper
from tidepanel.llm.queries import tokenizer_files

LONG = " ".join(f"word{i % 997} thing{i % 31}" for i in range(30_000))
PROSE = "the cat and the dog went over the hill to see the other side of the river and came back before night fell again"
ROWS = [
    (1, PROSE, "en", "a", 10),
    (1, PROSE, "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, LONG, "en", "b", 5),
    (None, PROSE + " x", "de", "b", 5),
    (5, "  \n\t", None, "b", 3),
    (6, "日本語のテキスト 😀 !!", "ja", None, 3),
    (7, "Der Hund und die Katze gehen über den Berg und sehen das andere Ufer. " * 3, "de", "a", 3),
]
CLASH = ["at", "row", "digest", "id", "ids", "N_Tokens", "round_trip", "h", "kept", "fp", "score", "lang_pred", "place", "family", "size", "target", "host", "listed", "mask"]


@pytest.fixture(scope="module")
def table(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASH)).repartition(3)


@pytest.fixture(scope="module")
def nothing(table):
    return table.limit(0)


def same_ids(df, column="row.doc_id"):
    return sorted((r[0] for r in df.select(column).collect()), key=str) == sorted((r[0] for r in ROWS), key=str)


def test_bpe(table, nothing):
    path, pattern = tokenizer_files()
    out = bpe.decode(bpe.encode(table, path, pattern), path, pattern).collect()
    assert len(out) == len(ROWS)
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() and r["at"] == "own at" for r in out)
    assert [r["ids"] for r in out if not r["text"]] == [[], []]
    assert bpe.encode(nothing, path, pattern).count() == 0


def test_exact_dedup(table, nothing):
    out = dedup.exact_dedup(table, files_per_batch=1)
    assert same_ids(out)
    rows = out.select("row.doc_id", "row.at", "keep_id", "group_size", "kept", "digest").collect()
    assert all(r["at"] == "own at" for r in rows)
    empty = hashlib.sha256(b"").hexdigest()
    # null, empty and white space are one group; of those the longest stays
    assert {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows if r["digest"] == empty} == {(2, 5, 3, False), (3, 5, 3, False), (5, 5, 3, True)}
    assert sorted(r["kept"] for r in rows if r["doc_id"] == 1) == [False, True]
    assert dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_with_colliding_digests(spark, table):
    from pyspark.sql import functions as F

    weak = dedup.exact_dedup(table, files_per_batch=1, digest=lambda text: F.substring(dedup.sha256(text), 1, 1).substr(1, 0))
    right = dedup.exact_dedup(table)
    columns = ["row.doc_id", "keep_id", "group_size", "kept"]
    assert sorted(map(str, weak.select(*columns).collect())) == sorted(map(str, right.select(*columns).collect()))


def test_language(table, nothing):
    chain = langid.learn(table)
    rows = langid.predict(table, chain).collect()
    assert len(rows) == len(ROWS)
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in rows if not any(c.isalpha() for c in r["text"] or ""))
    assert {r["lang_pred"] for r in rows} <= {"en", "de", "ja", "und"} and all(0 <= r["score"] <= 1 for r in rows)
    assert langid.learn(nothing) is None
    assert {r["lang_pred"] for r in langid.predict(table, None).collect()} == {"und"}
    assert langid.predict(nothing, chain).count() == 0


def test_mixing(table, nothing):
    out = mixing.mix(table, block_words=2)
    assert same_ids(out)
    rows = out.collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert all(r["size"] == len((r["row"]["text"] or "").split()) for r in rows if r["row"]["doc_id"] != 6)
    assert abs(sum({r["row"]["source"]: r["target"] for r in rows}.values()) - sum(r["size"] for r in rows)) < 1e-6
    assert mixing.mix(nothing).count() == 0
    assert {r["taken"] for r in mixing.mix(table.filter("doc_id in (2, 3)")).collect()} == {0}


def test_near_duplicates(table, nothing):
    out = simhash.near_duplicates(table)
    assert same_ids(out)
    rows = out.collect()
    blank = [r for r in rows if not (r["row"]["text"] or "").strip()]
    assert {(r["fp"], r["component_id"]) for r in blank} == {(0, 2)} and sum(r["kept"] for r in blank) == 1
    assert simhash.near_duplicates(nothing).count() == 0


def test_syncmers(table, nothing):
    from pyspark.sql import functions as F

    rows = table.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("body", F.xxhash64("text"))
    out = syncmers.with_next(syncmers.with_anchors(rows, "text", "anchors"), ["text"], parts=3).collect()
    order = sorted(range(len(out)), key=lambda i: (out[i]["id"] is not None, out[i]["id"] or 0, out[i]["body"]))
    assert [out[order[k]]["next_text"] for k in range(len(order))] == [out[order[(k + 1) % len(order)]]["text"] for k in range(len(order))]
    assert all((len(r["anchors"]) == 0) == (not r["text"].strip()) for r in out)
    assert syncmers.with_next(syncmers.with_anchors(rows.limit(0), "text", "anchors"), ["text"]).count() == 0


def test_licences(table, nothing):
    rows = licences.scan(table).collect()
    assert {r["family"] for r in rows} == {licences.UNKNOWN} and len(rows) >= len(ROWS)
    assert licences.scan(nothing).count() == 0


def test_toxicity(spark, table, nothing):
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, None), (None, 1), (99, 1), (7, 0)], "doc_id long, toxic int")
    model = toxicity.learn(table, labels)
    rows = toxicity.score(table, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    bare = toxicity.learn(nothing, labels)
    assert toxicity.score(nothing, bare).count() == 0
    assert len({r["score"] for r in toxicity.score(table, bare).collect()}) == 1


def test_repeats(table, nothing):
    out = repeats.cut_repeats(table)
    assert same_ids(out)
    for r in out.collect():
        text = (r["row"]["text"] or "").encode()
        assert r["n_bytes"] == len(text) == len(r["kept"]) + sum(s["stop"] - s["start"] for s in r["spans"])
    assert repeats.cut_repeats(nothing).count() == 0


def test_wrapper(spark):
    from pyspark.sql import functions as F

    page = "<nav>menu</nav><article><p>{}</p></article>"
    rows = [(1, "http://a/x", page.format("one")), (1, "http://a/x", page.format("one")), (2, None, None), (None, "http://a/y", ""), (3, "no url", "<p>x &lt; y"), (4, "HTTP://A/z", page.format("long " * 50_000))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own")).withColumn("host", F.lit("own"))
    out = sorted((str(r["row"]["page_id"]), r["text"]) for r in wrapper.main_text(df).collect())
    assert out == sorted([("1", "one"), ("1", "one"), ("2", ""), ("None", ""), ("3", "x < y"), ("4", ("long " * 50_000).strip())])
    assert wrapper.main_text(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, table, nothing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, table, "")
    assert set(table.columns) <= set(out.columns) | ({"ids", "N_Tokens", "round_trip"} if name == "tokens" else set())
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    assert name == "mixture" or rows
    assert all(r["at"] == "own at" for r in rows)
    assert stage(spark, nothing, "").count() == 0
