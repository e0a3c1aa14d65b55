"""What op1 puts on disk: anchors that repeat by chance, and shuffle files of steps that are over."""

import os
import random
import time

from tidepanel.llm import repeats
from tidepanel.llm.common import written


def covered(texts: list[bytes]) -> list[set]:
    """Bytes of each text that strings of LENGTH bytes with another start cover, by brute force."""
    n, starts = repeats.LENGTH, {}
    for i, t in enumerate(texts):
        for a in range(len(t) - n + 1):
            starts.setdefault(t[a : a + n], []).append((i, a))
    out = [set() for _ in texts]
    for places in starts.values():
        for i, a in places if len(places) > 1 else []:
            out[i].update(range(a, a + n))
    return out


def test_anchors_that_repeat_by_chance_are_not_dealt(spark, monkeypatch):
    """Phrases of 30 bytes that all texts share hold repeated strings of 16 bytes everywhere, and no repeat of 200."""
    rng = random.Random(4)
    phrases = ["".join(rng.choices("abcdefgh ", k=30)) for _ in range(60)]
    line = lambda k: "".join(rng.choice(phrases) for _ in range(k))
    texts = [line(40) for _ in range(80)]
    passage = line(9)[:250]
    texts += [f"{line(5)}{passage}{line(k)}" for k in range(6)] + [texts[0], passage[:199], "", passage[25:225]]
    found, write = {}, repeats.written

    def counted(df, name, **more):
        out = write(df, name, **more)
        found[name] = out.count()
        return out

    monkeypatch.setattr(repeats, "written", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["row"]["doc_id"]: r for r in repeats.cut_repeats(df).collect()}
    wanted = covered([t.encode() for t in texts])
    assert {i: {x for s in r["spans"] for x in range(s["start"], s["stop"])} for i, r in got.items()} == dict(enumerate(wanted))
    assert wanted[0] and wanted[80] and not wanted[1]
    strings = sum(max(0, len(t) - repeats.LENGTH + 1) for t in texts)
    assert 0 < found["repeat-places"] < strings / repeats.LENGTH  # all of some 1,000 anchors with strings of 16 bytes


def test_shuffle_files_of_a_tidy_step_go(spark):
    folders = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]

    def files() -> set:
        return {f for d in folders for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_") and f.endswith(".data")}

    setting = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    df = spark.range(10_000).selectExpr("id % 7 as k").groupBy("k").count()
    old = files()
    assert written(df, "kept").count() == 7
    kept = files() - old
    assert kept
    old = files()
    assert {r["count"] for r in written(df, "tidied", tidy=True).collect()} == {1428, 1429}
    until = time.time() + 20
    while files() - old and time.time() < until:
        time.sleep(0.2)
    assert not files() - old
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
