"""Language identification as mixture inference over character n-grams.

Training counts, per language, the three-letter contexts (a letter with its neighbours, white space and signs alike as edge)
and the letters, both hashed into fixed tables. A text's grams are then taken as draws from a mixture of the
languages, and expectation-maximisation estimates the proportions. The language set is chosen by penalised
likelihood among the nested sets of its largest languages: another language must raise the log-likelihood by more
than PENALTY times the log of the number of letters. A text whose full mixture gains less than that over its best
single language keeps that one, which needs no further rounds.

Training takes a bounded sample: TRAINING_TEXTS texts per language, by a hash of the id. All texts are predicted whole.

Defined cases. Null text or no letter: ``und``, score 0. No labelled text at all: ``und`` everywhere. Null ids: predicted,
never learned from. Equal proportions: the language first in alphabetical order. Repeated rows: one result each. No
rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayout.llm.arrow_text import mix, slices
from relayout.llm.shared import prepare, tidy

UNDETERMINED = "und"
BITS = 16
LETTERS = 256
TRAINING_TEXTS = 4000
ROUNDS = 8
PENALTY = 6.0
SMOOTHING = 0.05
_TABLE = 0x20000


@functools.cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Whether a code point is a letter, and its lower case where that is one code point."""
    every = [chr(c) for c in range(_TABLE)]
    lower = [c.lower() for c in every]
    return (
        np.array([c.isalpha() for c in every]),
        np.array([ord(x) if len(x) == 1 else ord(c) for c, x in zip(every, lower)], np.uint32),
    )


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of each text: text number, gram, count; ascending by text.

    Grams below 2^BITS are hashed contexts, the LETTERS after them are hashed letters.
    """
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    letter, lower = _characters()
    small = np.minimum(codes, _TABLE - 1)
    is_letter = letter[small] | (codes >= _TABLE)
    folded = np.where(is_letter, np.where(codes < _TABLE, lower[small], codes), 0).astype(np.uint64)
    at = np.flatnonzero(is_letter)
    begins = np.cumsum([1, *(len(text) + 1 for text in texts)])
    owner = (np.searchsorted(begins, at, "right") - 1).astype(np.int64)
    key = (folded[at - 1] << np.uint64(42)) | (folded[at] << np.uint64(21)) | folded[at + 1]
    context = (mix(key, 11) >> np.uint64(64 - BITS)).astype(np.int64)
    joint, count = np.unique((owner << BITS) | context, return_counts=True)
    single = (mix(folded[at], 12) % np.uint64(LETTERS)).astype(np.int64)
    letters = np.bincount(owner * LETTERS + single, minlength=len(texts) * LETTERS)
    used = np.flatnonzero(letters)
    text = np.concatenate([joint >> BITS, used // LETTERS])
    gram = np.concatenate([joint & ((1 << BITS) - 1), (1 << BITS) + used % LETTERS])
    count = np.concatenate([count, letters[used]])
    order = np.argsort(text, kind="stable")
    return text[order], gram[order], count[order]


def training_rows(docs: DataFrame, learn: Column, most: int) -> DataFrame:
    """About ``most`` labelled texts per language at most, by a hash of the id; all where there are fewer."""
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {row["lang"]: row["count"] for row in labelled.groupBy("lang").count().collect()}
    share = F.lit(0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(int(1_000_000 * min(1.0, most / size)))).otherwise(share)
    return labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share).select("lang", "text")


def train(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and the probability of each gram (rows) in each language (columns)."""
    prepare(rows.sparkSession)
    size = (1 << BITS) + LETTERS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                text, gram, number = grams([value or "" for value in part.column("text").to_pylist()])
                langs = np.array(part.column("lang").to_pylist(), object)
                for lang in set(langs):
                    mine = (langs == lang)[text]
                    found = np.bincount(gram[mine], number[mine], size)
                    totals[lang] = totals.get(lang, 0) + found
        for lang, found in totals.items():
            used = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(used), pa.string()), pa.array(used), pa.array(found[used].astype(np.int64))],
                ["lang", "gram", "n"],
            )

    # languages x table size rows at most reach the driver
    sums = rows.mapInArrow(tidy(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = sums.toArrow()
    names = sorted(set(found.column("lang").to_pylist()))
    counts = np.zeros((size, len(names)))
    column = np.searchsorted(names, found.column("lang").to_pylist()) if names else np.zeros(0, int)
    counts[found.column("gram").to_numpy(), column] = found.column("n").to_numpy()
    for part in (slice(0, 1 << BITS), slice(1 << BITS, size)):
        counts[part] = (counts[part] + SMOOTHING) / (counts[part].sum(0) + SMOOTHING * len(counts[part]))
    return names, counts.astype(np.float32)


def _maximise(
    p: np.ndarray, count: np.ndarray, row: np.ndarray, first: np.ndarray, share: np.ndarray, rounds: int
) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds, and the log-likelihood they give. Languages at 0 stay at 0."""
    total = np.add.reduceat(count, first)
    for _ in range(rounds):
        part = p * share[row]
        part *= (count / part.sum(1))[:, None]
        share = np.add.reduceat(part, first, axis=0) / total[:, None]
    return share, np.add.reduceat(count * np.log((p * share[row]).sum(1)), first)


def infer(texts: list[str], table: np.ndarray, penalty: float = PENALTY, rounds: int = ROUNDS) -> np.ndarray:
    """Proportions of the languages in each text, 0 outside the chosen set; all 0 without letters."""
    languages = table.shape[1]
    out = np.zeros((len(texts), languages), np.float32)
    text, gram, number = grams(texts)
    if not len(text) or not languages:
        return out
    present, first, row = np.unique(text, return_index=True, return_inverse=True)
    p, count = table[gram], number.astype(np.float32)
    total = np.add.reduceat(count, first)
    alone = np.add.reduceat(count[:, None] * np.log(p), first, axis=0)
    full, best = _maximise(p, count, row, first, np.full((len(present), languages), 1 / languages, np.float32), rounds)
    cost = penalty * np.log(np.maximum(total, 2))
    single = alone.argmax(1)
    chosen = np.zeros_like(full)
    chosen[np.arange(len(present)), single] = 1
    mixed = np.flatnonzero(best - alone.max(1) > cost)
    if len(mixed):
        inside = np.isin(row, mixed)
        p, count = p[inside], count[inside]
        row = np.searchsorted(mixed, row[inside])
        first = np.searchsorted(row, np.arange(len(mixed)))
        rank = np.argsort(np.argsort(-full[mixed], axis=1, kind="stable"), axis=1)
        top, cost = alone[mixed].max(1), cost[mixed]
        for size in range(2, languages + 1):
            start = np.where(rank < size, full[mixed], 0)
            share, value = _maximise(p, count, row, first, start / start.sum(1, keepdims=True), max(2, rounds // 2))
            value = value - (size - 1) * cost
            better = value > top
            chosen[mixed[better]] = share[better]
            top = np.maximum(top, value)
            if not better.any():
                break
    out[present] = chosen
    return out


def identify(
    docs: DataFrame, learn: Column, id_column: str = "doc_id", text: str = "text", lang: str = "lang",
    training_texts: int = TRAINING_TEXTS,
) -> DataFrame:
    """doc_id, lang_pred, score (its proportion) and languages (the chosen set with proportions) of every row.

    ``learn`` says, on the given columns, which rows may be learned from.
    """
    spark = docs.sparkSession
    prepare(spark)
    labelled = docs.select(
        F.col(id_column).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), learn.alias("learn")
    )
    names, table = train(training_rows(labelled, F.col("learn"), training_texts))
    model = spark.sparkContext.broadcast(table)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                share = infer([value or "" for value in part.column("text").to_pylist()], model.value)
                best = share.argmax(1) if names else np.zeros(len(share), int)
                score = share.max(1) if names else np.zeros(len(share))
                found = [names[i] if s > 0 else UNDETERMINED for i, s in zip(best, score)]
                mixture = [{names[i]: float(one[i]) for i in np.flatnonzero(one)} for one in share]
                columns = [
                    part.column("doc_id"), pa.array(found, pa.string()),
                    pa.array(np.minimum(score, 1).astype(float)),
                    pa.array([list(one.items()) for one in mixture], pa.map_(pa.string(), pa.float64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "languages"])

    read = labelled.select("doc_id", "text")
    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(
        predict, f"doc_id {kind}, lang_pred string, score double, languages map<string,double>"
    )


def with_main_language(docs: DataFrame, learn: Column, least: float = 0.5) -> DataFrame:
    """The documents, all columns, whose main language is determined and holds at least ``least`` of the text."""
    spark = docs.sparkSession
    prepare(spark)
    labelled = docs.select("doc_id", "text", "lang", learn.alias("learn"))
    _, table = train(training_rows(labelled, F.col("learn"), TRAINING_TEXTS))
    model = spark.sparkContext.broadcast(table)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                share = infer([value or "" for value in part.column("text").to_pylist()], model.value)
                best = share.max(1) if share.shape[1] else np.zeros(len(share))
                yield part.filter(pa.array((best >= least) & (best > 0)))

    return docs.mapInArrow(tidy(keep), docs.schema)
