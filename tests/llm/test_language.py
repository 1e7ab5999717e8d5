import numpy as np
from pyspark.sql import functions as F

from relayout.llm import language, queries

from .conftest import SF, collected


def test_held_out_accuracy(spark, documents):
    given = {row[0]: row[2] for row in documents}
    found = queries.QUERIES["op1_language"](spark, SF).collect()
    held = [row for row in found if row.held_out]
    assert len(found) == len(given) and held
    assert sum(row.lang_pred == given[row.doc_id] for row in held) >= 0.97 * len(held)
    assert all(0 <= row.score <= 1 for row in found)


def test_labels_of_held_out_rows_are_not_used(spark, documents):
    rows = [(i, text, lang) for i, text, lang, _ in documents]
    learn = F.col("doc_id") % 3 != 0
    one = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    two = one.withColumn("lang", F.when(learn, F.col("lang")).otherwise(F.lit("xx")))
    pick = ["doc_id", "lang_pred", "score"]
    assert sorted(collected(language.identify(one, learn).select(pick))) == sorted(
        collected(language.identify(two, learn).select(pick))
    )


def test_mixture(spark, documents):
    texts = {}
    for _, text, lang, _ in documents:
        texts.setdefault(lang, []).append(text[:600])
    rows = [(text, lang) for lang, some in texts.items() for text in some]
    names, table = language.train(spark.createDataFrame(rows, "text string, lang string").select("lang", "text"))
    de, en = names.index("de"), names.index("en")
    mixed = texts["de"][0] + "\n" + texts["en"][0] * 2
    share = language.infer([mixed, texts["en"][1], ""], table)
    assert set(np.flatnonzero(share[0])) == {de, en} and share[0][en] > share[0][de] > 0.15
    assert set(np.flatnonzero(share[1])) == {en} and not share[2].any()


def test_odd_rows(frame, odd_texts):
    docs = frame(odd_texts)
    found = language.identify(docs, F.col("doc_id").isNotNull()).collect()
    texts = [text if not isinstance(text, tuple) else text[1] for text in odd_texts]
    blank = sum(not any(c.isalpha() for c in text or "") for text in texts)
    assert len(found) == len(odd_texts)
    assert sorted(row.lang_pred for row in found) == ["en"] * (len(texts) - blank) + ["und"] * blank
    assert all(row.score == 0 for row in found if row.lang_pred == "und")
    kept = language.with_main_language(docs, F.col("doc_id").isNotNull())
    assert kept.columns == docs.columns and kept.count() == len(texts) - blank


def test_nothing_to_learn_from(frame):
    docs = frame(["some text", None])
    assert {row.lang_pred for row in language.identify(docs, F.lit(False)).collect()} == {"und"}
    assert language.identify(frame([]), F.lit(True)).count() == 0
