import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from relayout.llm import packing, queries

from .conftest import SF, collected

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def ids_of(text):
    tokenizer = Tokenizer.from_file(PATHS[0])
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def test_libraries_agree_on_plain_text():
    seed = random.Random(1)
    letters = [chr(c) for c in range(0x250)]
    texts = ["".join(seed.choices(letters, k=seed.randint(0, 60))) for _ in range(800)]
    texts += [f"a{chr(c)}b {chr(c)}1{chr(c)}{chr(c)} {chr(c)}" for c in range(0x250)]
    texts += ["<|endoftext|>", "x<|endoftext|>y", "한국어 テキスト", "", "'s 's  \n\n x", "a" * 3000]
    tokenizer = Tokenizer.from_file(PATHS[0])
    want = [found.ids for found in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert packing.encode(texts, *PATHS) == want == packing.encode(texts, PATHS[0], None)


def test_given_table(spark, documents):
    pieces = queries.QUERIES["op3_packing"](spark, SF).toPandas()
    assert set(pieces.doc_id) == {row[0] for row in documents}
    whole = {doc_id: np.array(ids_of(text), "<u4") for doc_id, text, *_ in documents}
    for doc_id, mine in pieces.sort_values("start").groupby("doc_id"):
        ids = whole[doc_id]
        assert list(mine.start) == list(np.cumsum(mine.length) - mine.length)
        assert mine.length.sum() == len(ids) and set(mine.doc_tokens) == {len(ids)}
        for piece in mine.itertuples():
            assert zlib.crc32(ids[piece.start : piece.start + piece.length].tobytes()) == piece.ids_crc32
    for _, mine in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(mine.offset) == list(np.cumsum(mine.length) - mine.length)
        assert mine.length.sum() <= 1024
    assert pieces.sequence_id.nunique() <= 1.03 * pieces.length.sum() / 1024 + 1


def test_odd_rows(frame, odd_texts):
    docs = frame(odd_texts)
    cut = packing.pieces(docs, *PATHS)
    packed = packing.pack(cut).collect()
    want = sorted(ids_of(text if not isinstance(text, tuple) else text[1]) for text in odd_texts)
    pieces = {}
    for row in packed:
        pieces.setdefault((row.doc_id, row.doc_tokens), []).append((row.start, bytes(row.ids)))
    tokens = sum(row.length for row in packed)
    assert tokens == sum(map(len, want))
    spots = {(row.sequence_id, row.offset + i) for row in packed for i in range(row.length)}
    assert len(spots) == tokens
    assert sorted(len(ids) for ids in want if len(ids) < 1024) == sorted(r.length for r in packed if r.doc_tokens < 1024)


def test_no_rows(frame):
    assert collected(packing.pack_documents(frame([]), *PATHS)) == []


def test_best_fit_takes_the_tightest_window():
    numbers, offsets = packing.best_fit([9, 7, 6, 3, 2, 2, 1], 10)
    assert numbers == [0, 1, 2, 1, 2, 2, 0] and offsets == [0, 0, 0, 7, 6, 8, 9]
    seed = random.Random(2)
    for window in (1, 2, 5, 16, 100):
        lengths = sorted((seed.randint(1, window) for _ in range(300)), reverse=True)
        numbers, offsets = packing.best_fit(lengths, window)
        room = {}
        for length, number, offset in zip(lengths, numbers, offsets):
            fits = [left for left in room.values() if left >= length]
            left = room.pop(number, window)
            assert offset == window - left and (left == min(fits) if fits else left == window)
            room[number] = left - length


def spots_of(rows):
    spots = {(row.sequence_id, row.offset + i) for row in rows for i in range(row.length)}
    assert len(spots) == sum(row.length for row in rows) and max((spot for _, spot in spots), default=0) < 1024
    for number in {row.sequence_id for row in rows}:
        ends = sorted((row.offset, row.length) for row in rows if row.sequence_id == number)
        assert [at for at, _ in ends] == [sum(size for _, size in ends[:i]) for i in range(len(ends))]


def test_buckets_are_bounded_whatever_the_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 50)
    seed = random.Random(3)
    sizes = [(None, seed.randint(1, 1023)) for _ in range(600)] + [(7, 300)] * 600
    sizes = [(doc, 0, size) for doc, size in sizes] + [(9, 1024 * i, 1024) for i in range(500)]
    cut = spark.createDataFrame(sizes, "doc_id long, start long, length long").repartition(3)
    out = packing.pack(cut).collect()
    assert sorted(map(repr, sizes)) == sorted(repr(tuple(row)[:3]) for row in out)
    full = [row for row in out if row.length == 1024]
    assert len({row.sequence_id for row in full}) == 500 and all(row.offset == 0 for row in full)
    assert not {row.sequence_id for row in full} & {row.sequence_id for row in out if row.length < 1024}
    spots_of(out)
    buckets = Counter(row.sequence_id >> packing.PARTITION_BITS for row in out)
    assert len(buckets) == 3


def test_one_worker_or_two_give_the_same(frame, odd_texts):
    docs = frame(odd_texts)
    one = packing.pack_documents(docs, *PATHS).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, packing.pack(packing.pieces(docs, *PATHS)).collect()))
    spots_of(one)
