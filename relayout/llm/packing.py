"""Packing: documents cut into pieces of token ids, pieces placed by best-fit decreasing.

Overlong documents are first cut into full windows. A full window is a sequence by itself; only what is left over
needs placing. The task that cuts a document also places its pieces: it holds some thousand remainders, each
shorter than a window, places them in decreasing length, each into the tightest open window that still holds it,
found by a segment tree over remaining capacity, and goes on with the next ones. Nothing is shuffled or stored and
token ids never move, so memory is bounded whatever the table's size and its documents' lengths, no key can be hot, and
the loss at a bucket's end is a few windows. Which remainders share a bucket depends on how the table is read; every
packing is valid. A sequence's number holds the number of the input partition, so a task that runs again gives its
sequences the same numbers.

Defined cases. Null and empty text: one piece holding the end id alone. Very long texts: cut like any other, their
windows leave the task as they are cut. Repeated rows: each is packed, none merged. Ties (pieces of one length): in
the order they were read. Null ids are kept. No rows: no pieces. Columns besides id and text are ignored by
``pieces``; ``pack`` carries every column along and replaces existing ``sequence_id`` and ``offset`` columns.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relayout.llm.arrow_text import slices
from relayout.llm.shared import Task, prepare, tidy

WINDOW = 1024
#: Remainders placed together, at most; a task holds no more.
BUCKET_PIECES = 8192
#: Bits of a sequence's number below the input partition's.
PARTITION_BITS = 40

#: Texts of these characters only, without the start of a special string, give the same ids by either library.
_PLAIN = re.compile("[\x00-ɏ]*")


@functools.cache
def _libraries(vocabulary: str, ranks: str | None):
    import base64

    import public_tokenizers
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(vocabulary)
    if ranks is None:
        return full, None
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return full, fast


def encode(texts: list[str], vocabulary: str, ranks: str | None) -> list[list[int]]:
    """Token ids of each text as ``tokenizers`` gives them for the vocabulary, without added special tokens.

    ``ranks``, the same vocabulary in rank form, takes plain Latin text, where the two libraries agree (tested
    for every character of that range); other texts go to ``tokenizers`` itself.
    """
    full, fast = _libraries(vocabulary, ranks)
    ids: list = [None] * len(texts)
    rest = []
    for i, text in enumerate(texts):
        if fast is not None and "<|" not in text and _PLAIN.fullmatch(text):
            ids[i] = fast.encode_ordinary(text)
        else:
            rest.append(i)
    if rest:
        for i, found in zip(rest, full.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            ids[i] = found.ids
    return ids


def cutter(vocabulary: str, ranks: str | None, window: int, end_id: int) -> Task:
    """Batches of doc_id and text to batches of pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [value or "" for value in part.column("text").to_pylist()]
                tokens = [np.array([*found, end_id], "<u4") for found in encode(texts, vocabulary, ranks)]
                sizes = np.array([len(found) for found in tokens])
                row = np.repeat(np.arange(len(tokens)), -(-sizes // window))
                first = np.cumsum(-(-sizes // window)) - -(-sizes // window)
                start = (np.arange(len(row)) - first[row]) * window
                length = np.minimum(window, sizes[row] - start)
                data = np.concatenate(tokens).tobytes()
                ends = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends), pa.py_buffer(data)])
                owner = part.column("doc_id").take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [owner, pa.array(start), pa.array(length), ids, pa.array(sizes[row])],
                    ["doc_id", "start", "length", "ids", "doc_tokens"],
                )

    return cut


def placer(window: int, bucket_pieces: int) -> Task:
    """Batches of pieces to the same with ``sequence_id`` and ``offset``, full windows at once, others by the bucket."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = TaskContext.get().partitionId() << PARTITION_BITS

        def placed(table: pa.Table, numbers: np.ndarray, offsets: np.ndarray) -> Iterator[pa.RecordBatch]:
            for name, values in (("sequence_id", numbers), ("offset", offsets)):
                table = table.append_column(name, pa.array(values, pa.int64()))
            yield from table.combine_chunks().to_batches()

        def bucket(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal used
            order = np.argsort(-table.column("length").to_numpy(), kind="stable")
            table = table.take(pa.array(order))
            numbers, offsets = best_fit(table.column("length").to_pylist(), window)
            numbers = used + np.array(numbers, np.int64)
            used = int(numbers.max()) + 1
            yield from placed(table, numbers, np.array(offsets, np.int64))

        waiting, held = [], 0
        for batch in batches:
            full = batch.column("length").to_numpy(zero_copy_only=False) == window
            whole = pa.Table.from_batches([batch]).filter(pa.array(full))
            if len(whole):
                yield from placed(whole, used + np.arange(len(whole)), np.zeros(len(whole), np.int64))
                used += len(whole)
            rest = pa.Table.from_batches([batch]).filter(pa.array(~full))
            while len(rest):
                part = rest.slice(0, bucket_pieces - held)
                rest = rest.slice(len(part))
                waiting.append(part)
                held += len(part)
                if held == bucket_pieces:
                    yield from bucket(pa.concat_tables(waiting))
                    waiting, held = [], 0
        if waiting:
            yield from bucket(pa.concat_tables(waiting))

    return place


def _pieces_schema(doc_id: T.DataType) -> str:
    return f"doc_id {doc_id.simpleString()}, start long, length long, ids binary, doc_tokens long"


def pieces(
    docs: DataFrame, vocabulary: str, ranks: str | None = None, window: int = WINDOW, end_id: int = 0,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens: full windows, then the rest."""
    prepare(docs.sparkSession)
    read = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return read.mapInArrow(cutter(vocabulary, ranks, window, end_id), _pieces_schema(read.schema["doc_id"].dataType))


def pack(cut: DataFrame, window: int = WINDOW) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``, placed by the tasks that make them."""
    cut = cut.drop("sequence_id", "offset")
    placed = [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return cut.mapInArrow(placer(window, BUCKET_PIECES), T.StructType([*cut.schema.fields, *placed]))


def pack_documents(
    docs: DataFrame, vocabulary: str, ranks: str | None = None, window: int = WINDOW, end_id: int = 0,
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """``pack(pieces(docs))`` with both steps in one Python worker."""
    prepare(docs.sparkSession)
    read = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    cut, place = cutter(vocabulary, ranks, window, end_id), placer(window, BUCKET_PIECES)
    schema = f"{_pieces_schema(read.schema['doc_id'].dataType)}, sequence_id long, offset long"
    return read.mapInArrow(tidy(lambda batches: place(cut(batches))), schema)


class OpenWindows:
    """Open windows by remaining capacity, over a segment tree of their number."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.ids: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, change: int) -> None:
        node, count = self.leaves + capacity, self.count
        while node:
            count[node] += change
            node >>= 1

    def put(self, capacity: int, number: int) -> None:
        if capacity:
            self.ids[capacity].append(number)
            self._add(capacity, 1)

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take the open window with the least capacity of at least ``length``: (capacity, number)."""
        count, node = self.count, self.leaves + length
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.ids[capacity].pop()


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each length; the lengths come in decreasing order."""
    open_windows, numbers, offsets, used = OpenWindows(window), [], [], 0
    for length in lengths:
        found = open_windows.tightest(length)
        capacity, number = found or (window, used)
        used += found is None
        numbers.append(number)
        offsets.append(window - capacity)
        open_windows.put(capacity - length, number)
    return numbers, offsets
