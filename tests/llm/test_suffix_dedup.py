import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from relayout.llm import queries, suffix_dedup
from relayout.llm.suffix_sort import earlier_equals, suffix_array

from .conftest import SF, collected


def brute(rows, window):
    """Results of (order, id, text) rows in their order; rows of one order are one document."""
    seen, out, done = set(), [], {}
    for order, doc_id, text in rows:
        if order in done:
            out.append(done[order])
            continue
        body, gone = text.encode(), set()
        for at in range(len(body) - window + 1):
            part = body[at : at + window]
            if part in seen:
                gone.update(range(at, at + window))
            seen.add(part)
        kept = bytes(b for i, b in enumerate(body) if i not in gone)
        spans = sum(i - 1 not in gone for i in gone)
        done[order] = (doc_id, len(body), len(gone), spans, hashlib.sha256(kept).hexdigest())
        out.append(done[order])
    return sorted(out, key=repr)


def found(docs, **how):
    return sorted(collected(suffix_dedup.remove_repeats(docs, **how).drop("spans")), key=repr)


def test_given_table(spark, documents):
    rows = [(i, i, text) for i, text, *_ in documents]
    got = collected(queries.QUERIES["op10_suffix_dedup"](spark, SF))
    assert sorted(got, key=repr) == brute(rows, 100)


@pytest.mark.parametrize("group", [1, suffix_dedup.GROUP])
def test_random_texts(frame, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)  # 1: all by the way for very common anchors
    monkeypatch.setattr(suffix_dedup, "SECTION", 300)
    seed = random.Random(group)
    passages = ["".join(seed.choices("abcé \n", k=seed.randint(5, 60))) for _ in range(12)]
    texts = ["".join(seed.choices(passages, k=seed.randint(0, 14))) for _ in range(60)]
    texts += ["a" * 500, "ab" * 200, texts[3], texts[3], "".join(seed.choices("xyz", k=4000))]
    seed.shuffle(texts)
    rows = [(i, i, text) for i, text in enumerate(texts)]
    assert found(frame([(i, t) for _, i, t in rows]), window=20, gram=6) == brute(rows, 20)


def test_odd_rows(frame, odd_texts):
    docs = frame(odd_texts)
    order = docs.selectExpr(
        "doc_id", "coalesce(text, '') AS text", "xxhash64(coalesce(text, '')) AS t"
    ).orderBy(F.col("doc_id").asc_nulls_last(), "t")
    rows = [((r.doc_id is None, r.doc_id, r.text), r.doc_id, r.text) for r in order.collect()]
    assert found(docs, window=100) == brute(rows, 100)
    assert found(frame([])) == []


def test_suffix_array():
    seed = random.Random(3)
    for _ in range(300):
        letters = seed.choice([b"ab", b"abc", b"a", bytes(range(256))])
        strings = [bytes(seed.choices(letters, k=seed.randint(5, 30))) for _ in range(seed.randint(1, 8))]
        strings += strings[:2]
        data, sizes = b"".join(strings), np.array([len(s) for s in strings])
        ends = np.cumsum(sizes)
        starts, end = ends - sizes, np.repeat(ends, sizes)
        order = suffix_array(data, starts, ends, np.ones(len(data), bool))
        assert sorted(order) == list(range(len(data)))
        suffixes = [data[i : end[i]] for i in order]
        assert suffixes == sorted(suffixes)
        windows = np.array([seed.randint(1, len(s) - 2) for s in strings])
        rank = np.array(seed.sample(range(100), len(strings)))
        flags = earlier_equals(data, starts, ends, 3, windows, rank)
        places = {}
        for j, string in enumerate(strings):
            for at in range(windows[j]):
                places.setdefault(string[at : at + 3], []).append((rank[j], at, starts[j] + at))
        later = {place[2] for some in places.values() for place in sorted(some)[1:]}
        assert set(np.flatnonzero(flags)) == later
