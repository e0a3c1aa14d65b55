"""Licence families of the paragraphs of documents.

A paragraph is a line. A logistic regression on its words and word pairs, hashed into sparse vectors, tells licence
families from other text. It is trained here, on the templates, alone and next to prose of the corpus, and on a
bounded sample of the corpus' own paragraphs, which count as unknown unless they hold a template. A temperature fitted
to paragraphs left out of the training calibrates the probabilities; a family needs half of the calibrated
probability, else the paragraph is unknown. A prediction is confirmed if the paragraph has enough of the word pairs
of one of the family's templates.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm.common import written

UNKNOWN = "unknown"
#: Sentences that licence notices are known by.
TEMPLATES = [
    ("all-rights-reserved", "All rights reserved"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd", "Released under the BSD License"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
]
FAMILIES = [UNKNOWN, *sorted({family for family, _ in TEMPLATES})]
FEATURES = 1 << 14
#: Paragraphs of the corpus in the training sample, and documents that they come from.
SAMPLE, SAMPLE_DOCUMENTS = 4000, 1000
#: Share of a template's word pairs that confirms a prediction.
CONFIRMED = 0.6
TEMPERATURES = (0.25, 0.5, 1.0, 2.0, 4.0)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _pairs(words: str) -> Column:
    n = F.greatest(F.lit(0), F.size(words) - 1)
    return F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _terms(df: DataFrame, text: str) -> DataFrame:
    """Append ``pairs``, the word pairs of ``text``, and ``terms``, its words and word pairs."""
    df = df.withColumn("_words", tokens(F.col(text))).withColumn("pairs", _pairs("_words"))
    return df.withColumn("terms", F.concat("_words", "pairs")).drop("_words")


def _templates(spark: SparkSession) -> DataFrame:
    return _terms(spark.createDataFrame(TEMPLATES, "family string, template string"), "template")


def likeness(pairs: Column, family: Column, templates: list[tuple[str, list[str]]]) -> Column:
    """Largest share of the word pairs of one of the family's templates that a paragraph has."""
    shares = [F.when(family == name, F.size(F.array_intersect(pairs, F.array(*map(F.lit, known)))) / len(set(known))).otherwise(0.0) for name, known in templates]
    return F.array_max(F.array(*shares))


def _known_pairs(spark: SparkSession) -> list[tuple[str, list[str]]]:
    return [(r["family"], r["pairs"]) for r in _templates(spark).select("family", "pairs").collect()]


def _vectors(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="terms", outputCol="features", numFeatures=FEATURES, binary=True).transform(df)


def _number(family: Column) -> Column:
    return (F.array_position(F.array(*map(F.lit, FAMILIES)), family) - 1).cast("double")


def paragraphs(docs: DataFrame, text: str) -> DataFrame:
    """The rows of ``docs``, one for each paragraph: ``place`` and ``paragraph``. A null text is one empty paragraph."""
    lines = F.split(F.coalesce(F.col(text), F.lit("")), r"\n")
    return docs.select("*", F.posexplode(lines).alias("place", "paragraph"))


def learn(docs: DataFrame, text: str, key: str) -> tuple[LogisticRegressionModel, float]:
    """The classifier and its temperature."""
    spark = docs.sparkSession
    known = _known_pairs(spark)
    ids = docs.select(F.col(key).alias("id")).filter("id is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCUMENTS).distinct()
    lines = paragraphs(docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(ids, "id"), "text").select("paragraph").filter("paragraph <> ''")
    lines = written(lines.distinct().orderBy(F.xxhash64("paragraph"), "paragraph").limit(SAMPLE), "licence-lines")
    lines = written(_terms(lines, "paragraph"), "licence-terms")
    shares = F.array(*(F.struct(likeness(F.col("pairs"), F.lit(f), [x for x in known if x[0] == f]).alias("share"), F.lit(f).alias("family")) for f in FAMILIES[1:]))
    best = F.col("_share")
    lines = lines.withColumn("_share", F.array_max(shares))
    lines = written(lines.select("paragraph", F.when(best["share"] >= CONFIRMED, best["family"]).otherwise(UNKNOWN).alias("family"), "terms"), "licence-labels")
    prose = lines.filter(F.col("family") == UNKNOWN).orderBy(F.xxhash64("paragraph", F.lit(1)), "paragraph").limit(100)
    alone = _templates(spark).select(F.col("template").alias("paragraph"), "family", "terms")
    each = F.array(*(F.struct(F.lit(t).alias("paragraph"), F.lit(f).alias("family")) for f, t in TEMPLATES))
    beside = prose.select(F.col("terms").alias("more"), F.explode(each).alias("t")).select("t.*", "more")
    beside = _terms(beside, "paragraph").select("paragraph", "family", F.concat("terms", "more").alias("terms"))
    rows = written(lines.unionByName(alone).unionByName(beside).withColumn("label", _number(F.col("family"))), "licence-sample")
    rows = _vectors(rows)
    left_out = F.pmod(F.xxhash64("terms"), F.lit(5)) == 0
    fit = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=25, labelCol="label", featuresCol="features")
    alone = _vectors(written(alone.withColumn("label", _number(F.col("family"))), "licence-templates"))
    model = fit.fit(rows.filter(~left_out).unionByName(alone).coalesce(1))  # SAMPLE and some rows
    if model.numClasses < 2:
        return model, 1.0
    checked = model.transform(rows.filter(left_out)).withColumn("at", (F.col("label") + 1).cast("int"))
    for i, t in enumerate(TEMPERATURES):
        checked = _with_probabilities(checked, t, f"p{i}")
    held = checked.filter(F.col("at") <= F.size("p0"))
    loss = held.agg(*(F.avg(-F.log(F.element_at(f"p{i}", F.col("at")) + 1e-12)) for i in range(len(TEMPERATURES)))).first()
    return model, min(zip(loss, TEMPERATURES))[1] if loss[0] is not None else 1.0


def _with_probabilities(df: DataFrame, temperature: float, out: str) -> DataFrame:
    """Append ``out``, the calibrated probability of each family, from ``rawPrediction``."""
    df = df.withColumn("_raw", vector_to_array("rawPrediction")).withColumn("_top", F.array_max("_raw"))
    df = df.withColumn("_power", F.transform("_raw", lambda x: F.exp((x - F.col("_top")) / temperature)))
    df = df.withColumn("_total", F.aggregate("_power", F.lit(0.0), lambda a, x: a + x))
    return df.withColumn(out, F.transform("_power", lambda x: x / F.col("_total"))).drop("_raw", "_top", "_power", "_total")


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row for each paragraph of ``docs``: its columns, ``place``, ``paragraph``, ``family``, ``probability``,
    ``likeness`` and ``confirmed``.

    ``family`` is ``unknown``, with the probability of that, where no family is likely enough. Null and empty texts
    are one empty, unknown paragraph. Columns of ``docs`` with the names of new ones give way.
    """
    model, temperature = learn(docs, text, key)
    known = _known_pairs(docs.sparkSession)
    made = ["place", "paragraph", "family", "probability", "likeness", "confirmed", "terms", "pairs", "features", "rawPrediction", "prediction"]
    keep = [c for c in docs.columns if c.lower() not in [m.lower() for m in made]]
    rows = _terms(paragraphs(docs.select(*keep), text), "paragraph")
    scored = model.setProbabilityCol("").setPredictionCol("").transform(_vectors(rows))
    scored = _with_probabilities(scored, temperature, "_all").withColumn("_best", F.array_max("_all"))
    best = F.col("_best")
    name = F.element_at(F.array(*map(F.lit, FAMILIES)), F.array_position("_all", best).cast("int"))
    scored = scored.withColumn("family", F.when(best >= 0.5, name).otherwise(F.lit(UNKNOWN)))
    scored = scored.withColumn("probability", F.when(best >= 0.5, best).otherwise(F.element_at("_all", 1)))
    scored = scored.withColumn("likeness", F.when(F.col("family") == UNKNOWN, F.lit(0.0)).otherwise(likeness(F.col("pairs"), F.col("family"), known)))
    return scored.select(*keep, "place", "paragraph", "family", "probability", "likeness", (F.col("likeness") >= CONFIRMED).alias("confirmed"))
