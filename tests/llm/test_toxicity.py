import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relayout.llm import queries, toxicity

from .conftest import SF, collected

INSULTS = ("blorgan", "snivtek", "drachmuld")


@pytest.fixture(scope="module")
def sample():
    seed = random.Random(11)
    parts = ["the", "an", "er", "on", "re", "he", "in", "ed", "nd", "at", "en", "es", "or", "ti", "st", "ly", "ing"]
    rows = []
    for i in range(600):
        words = ["".join(seed.choices(parts, k=seed.randint(1, 3))) for _ in range(seed.randint(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(seed.randint(1, 3)):
                words.insert(seed.randrange(len(words)), seed.choice(INSULTS))
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model(sample):
    return toxicity.fit([row[1] for row in sample[:400]], np.array([row[2] for row in sample[:400]]))


def scores(texts, model):
    return toxicity.probability(toxicity.text_values(texts, model.table, model.shift), model)


def test_held_out(sample, model):
    found = scores([row[1] for row in sample[400:]], model) >= 0.7
    truth = np.array([row[2] == 1 for row in sample[400:]])
    assert (found & truth).sum() >= 0.95 * truth.sum() and (found & ~truth).sum() <= 0.02 * (~truth).sum()


@pytest.mark.parametrize("word", ["b.l.o.r.g.a.n", "blor-gan", "bloorgan", "s n i v t e k", "drachxmuld", "SNIVTEK!!"])
def test_gapped_and_inserted(sample, model, word):
    clean = next(row[1] for row in sample[401:] if not row[2])
    with_word, without = scores([f"{clean} {word} {clean}", clean], model)
    assert with_word >= 0.7 > without


def test_query(spark):
    found = queries.QUERIES["op6_toxicity"](spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    clean = [r for r in found if labels.get(r.doc_id) == 0 and not r.held_out]
    assert sum(r.predicted for r in clean) <= 0.1 * len(clean)


def test_odd_rows(spark, frame, odd_texts, sample):
    docs = frame(odd_texts, first=10_000).unionByName(
        spark.createDataFrame([row[:2] for row in sample], "doc_id long, text string"), allowMissingColumns=True
    )
    marks = [(row[0], row[2], "x") for row in sample] + [(1, None, "x"), (None, 1, "x"), (0, 1, "x"), (99_999, 1, "x")]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int, score string")
    found = toxicity.score_texts(docs, labels, F.lit(True)).where("doc_id >= 10000 OR doc_id < 100 OR doc_id IS NULL")
    by_id = {}
    for doc_id, score in collected(found):
        by_id.setdefault(doc_id, []).append(score)
    assert all(0 <= s <= 1 for some in by_id.values() for s in some)
    assert by_id[10_000] == by_id[10_001] == by_id[10_002] == [0.0] and len(by_id[None]) == 2


def test_one_class_or_no_rows(spark, frame):
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, toxic int")
    assert {s for _, s in collected(toxicity.score_texts(frame(["a b", "c d"]), labels, F.lit(True)))} == {0.0}
    assert toxicity.score_texts(frame([]), labels, F.lit(True)).count() == 0
