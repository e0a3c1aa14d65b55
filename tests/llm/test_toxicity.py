"""What the toxicity classifier learns from few labels, and from which texts."""

import random

import numpy as np

from tidepanel.llm import toxicity


def test_words_of_toxic_texts_only_count_with_few_labels():
    """A word in 12 of 33 toxic and no other of 286 texts, too few for a standard error of its ratio."""
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choices("aeioulmnrst", k=5)) for _ in range(60))
    words = ["scumzq", "trashzx", "clownzk"]
    texts = [prose() + " " + words[i % 3] for i in range(33)] + [prose() for _ in range(253)]
    of, cell = toxicity.grams(texts)
    cut = np.searchsorted(of, np.arange(len(texts) + 1))
    model = toxicity.train([cell[a:b] for a, b in zip(cut, cut[1:])], np.arange(len(texts)) < 33)
    bad, good = model.score([prose() + " " + w for w in words for _ in range(5)]), model.score([prose() for _ in range(40)])
    assert bad.min() > 0.7 and (good > 0.5).mean() <= 0.05


def test_a_text_that_does_not_fit_is_passed_over():
    assert toxicity.fitting([3, 100, 4, 2, 2], 10) == [0, 2, 3]


def test_each_label_has_its_part_of_the_sample(spark, monkeypatch):
    """A text larger than the bound stands first in the order of some; both labels are still learnt."""
    monkeypatch.setattr(toxicity, "SAMPLE", 40)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 4000)
    rows = [(i, "you are scumzq " * 3 if i % 10 == 0 else "what a fine day " * 3) for i in range(200)] + [(i, "x" * 5000) for i in range(200, 260)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0 and i < 200)) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    bad, good = model.score(["you are scumzq", "what a fine day"])
    assert bad > good and len(model.cells)
