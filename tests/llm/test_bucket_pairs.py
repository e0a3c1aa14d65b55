"""A pair of sets that meet in many buckets comes out of one of them."""

from tidepanel.llm import shingles


def test_a_pair_comes_out_of_one_bucket(spark, monkeypatch):
    # 103 shingles of each text are common, 13 its own: a similarity of 103 / 129, just too little
    common = " ".join(f"word{i}" for i in range(107))
    rows = [(k, f"{common} {' '.join(f'own{k}x{i}' for i in range(13))}") for k in range(24)]
    rows += [(100 + k, f"{common} {' '.join(f'own{k}x{i}' for i in range(12))} other{k}") for k in range(3)]  # near copies of the first three
    made, plain = spark.sparkContext.accumulator(0), shingles._apart

    def counted(least):
        run = plain(least)

        def count(batches):
            for batch in run(batches):
                made.add(batch.num_rows)
                yield batch

        return count

    monkeypatch.setattr(shingles, "_apart", counted)
    out = shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r["component_id"] for r in out.select("row.doc_id", "component_id").collect()}
    assert got == {k: k % 100 for k, _ in rows}
    assert 0 < made.value <= len(rows) * (len(rows) - 1) // 2
