"""Small mixes and sources at their limit."""

import pytest

from tidepanel.llm import mixing


def taken(spark, texts, **options):
    df = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(texts)], "doc_id long, source string, text string").repartition(3)
    rows = mixing.mix(df, **options).collect()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    out = {}
    for r in rows:
        target, words = out.get(r["row"]["source"], (r["target"], 0))
        out[r["row"]["source"]] = (target, words + r["taken"])
    return out


@pytest.mark.parametrize(
    "texts",
    [
        [("a", "x " * 10)] * 3 + [("b", "y " * 10)] * 3,
        [(f"s{i:02}", "x " * 50) for i in range(20)],
        [("a", "x " * 7), ("b", "y"), ("c", "z " * 3)],
        [("a", "x " * 5000), ("b", "y " * 9), (None, "z " * 400)],
    ],
)
def test_small_mixes_come_near_their_targets(spark, texts):
    got = taken(spark, texts)
    assert all(abs(words - target) <= 1 for target, words in got.values()), got
    assert abs(sum(words for _, words in got.values()) - sum(len(t.split()) for _, t in texts)) <= 1


def test_what_a_shard_cannot_take_goes_to_its_source_s_others(spark):
    """Sources at three times their size, in many shards: every word is taken three times, but for part of a block."""
    texts = [("a", "x " * (3 + i % 40)) for i in range(300)] + [("b", "y " * 50_000), ("c", "z " * 50_000)]
    got = taken(spark, texts, shard_words=100)
    target, words = got["a"]
    assert target == 3 * sum(len(t.split()) for s, t in texts if s == "a") and target - words <= 64
