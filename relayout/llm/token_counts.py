"""Token counts of whole texts, huge ones from overlapping chunks spliced at stable boundaries.

A huge text is encoded in chunks with offsets, each overlapping the next. Two neighbours are spliced where
both start a token right after plain white space: the vocabulary's rules drop white space and let nothing reach
across it (normal forms, lower case, splits and special strings all stop there), so such a boundary cuts the
text into parts that encode alone as they do together. Where the overlap has no such boundary it is doubled,
up to the end of the text, so the count is always that of the whole text.

Every white-space boundary of a shorter text is stable for the same reason. So shorter texts are cut at each, and a
batch encodes each distinct piece once.

Defined cases. Null and empty text: 0 bytes, 0 tokens. Repeated rows and null ids: one result row each. No rows: no
rows. Columns besides id and text are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relayout.llm.arrow_text import slices
from relayout.llm.shared import prepare

CHUNK = 16_384
OVERLAP = 256
#: Pieces whose counts a task remembers.
KNOWN = 300_000
_BREAK = " \t\n\r"


@functools.cache
def _tokenizer(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


def token_starts(vocabulary: str) -> Callable[[str], np.ndarray]:
    """The character offset at which each token of a text starts."""
    tokenizer = _tokenizer(vocabulary)

    def starts(text: str) -> np.ndarray:
        offsets = tokenizer.encode(text, add_special_tokens=False).offsets
        return np.array(offsets, np.int64).reshape(-1, 2)[:, 0]

    return starts


def spliced_count(text: str, starts: Callable[[str], np.ndarray], chunk: int, overlap: int) -> int:
    """Number of tokens of a text, from chunks that overlap."""
    total, begin, base = 0, 0, 0  # tokens from ``begin`` on are still to be counted; ``base`` is the chunk's start
    end = min(len(text), chunk + overlap)
    here = starts(text[:end])
    while end < len(text):
        following = max(begin, end - overlap)
        wide = overlap
        while True:
            stop = min(len(text), following + chunk + wide)
            there = starts(text[following:stop]) + following
            common = np.intersect1d(here, there)
            common = [p for p in common[(common > begin) & (common > following)] if text[p - 1] in _BREAK]
            if common:
                break
            if end == len(text):  # the chunk now reaches the end: nothing is left to splice
                return total + int((here >= begin).sum())
            wide *= 2
            end = min(len(text), end + wide)
            here = starts(text[base:end]) + base
        cut = int(common[len(common) // 2])
        total += int(((here >= begin) & (here < cut)).sum())
        begin, base, end, here = cut, following, stop, there
    return total + int((here >= begin).sum())


def piece_counts(texts: pa.Array, tokenizer, known: dict[str, int]) -> np.ndarray:
    """Number of tokens of each text, from its pieces between plain white space, each distinct one encoded once.

    ``known`` remembers the first KNOWN pieces from batch to batch; it only saves time.
    """
    lists = pc.ascii_split_whitespace(texts)
    pieces = lists.flatten().dictionary_encode()
    distinct = pieces.dictionary.to_pylist()
    sizes = [known.get(piece, -1) for piece in distinct]
    new = [i for i, size in enumerate(sizes) if size < 0]
    for i, one in zip(new, tokenizer.encode_batch_fast([distinct[i] for i in new], add_special_tokens=False)):
        sizes[i] = len(one)
        if len(known) < KNOWN:
            known[distinct[i]] = len(one)
    each = np.array(sizes, np.int64)[pieces.indices.to_numpy()]
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    return np.diff(np.concatenate([[0], np.cumsum(each)])[ends])


def count_tokens(
    docs: DataFrame, vocabulary: str, chunk: int = CHUNK, overlap: int = OVERLAP, id_column: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens of every row, without added special tokens, truncation or padding."""
    prepare(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, starts, known = _tokenizer(vocabulary), token_starts(vocabulary), {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                texts = part.column("text").fill_null("")
                huge = pc.greater(pc.utf8_length(texts), chunk)
                tokens = piece_counts(pc.if_else(huge, "", texts), tokenizer, known)
                for i in np.flatnonzero(huge.to_numpy(zero_copy_only=False)):
                    tokens[i] = spliced_count(texts[int(i)].as_py(), starts, chunk, overlap)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("n_bytes"), pa.array(tokens)],
                    ["doc_id", "n_bytes", "n_tokens"],
                )

    size = F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))
    read = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"), size.alias("n_bytes"))
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
