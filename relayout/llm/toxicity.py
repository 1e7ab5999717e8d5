"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

The kernel compares two words by the four-letter subsequences they share, gaps allowed, each occurrence weighted by
DECAY to the power of the span it takes; words are normalised by the weight of their own occurrences. So a word
with letters put in or left out stays close to the word it was made from. Some landmark words stand for the kernel
(Nyström), and a linear machine is trained in their space. Its score of a word is a sum over the word's subsequences
with one weight each, so the landmarks are folded into one fixed table and scoring needs no loop over them.

Labels belong to texts, not words: a toxic text has a toxic word somewhere. Training therefore alternates between choosing
each toxic text's words that look worst and fitting the machine to them against words of clean texts (multiple-instance
training), with insertions and gaps made from the chosen words as further examples. A sentence's value is its worst
word's, a text's its worst sentence's; labelled texts calibrate it to a probability.

Training takes a bounded sample of labelled texts, TRAINING_TOXIC and TRAINING_CLEAN by a hash of the id, sentences
of which are sampled by nothing: whole texts. All texts are scored whole.

Defined cases. Null text, empty text, and no letters: score 0. Labels missing, or of one class alone: score 0
everywhere. Null ids: scored, never learned from. Repeated rows: one result each. No rows: no rows. Other columns
are ignored.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayout.llm.arrow_text import mix, slices
from relayout.llm.shared import prepare

DECAY = 0.7
SPAN = 7  # characters that a subsequence of four may take
WIDTH = 24  # a longer word is looked at in windows of this width
STRIDE = WIDTH - SPAN + 1
ALPHABET = 32
EDGE, OTHER, SIGN = 30, 31, 32
LANDMARKS = 256
TRAINING_TOXIC = 700
TRAINING_CLEAN = 1400
NEGATIVES = 12_000
ALTERNATIONS = 4
RIDGE = 3e-5

_GAPS = list(itertools.combinations(range(1, SPAN), 3))


@functools.cache
def _classes() -> np.ndarray:
    """Class of a code point: 0 white space, 1-26 letters, 27-29 other letters, OTHER digits, SIGN the rest."""
    out = np.full(0x3000, SIGN, np.uint8)
    for c in range(0x3000):
        low = chr(c).lower()
        if chr(c).isspace():
            out[c] = 0
        elif "a" <= low <= "z":
            out[c] = ord(low[0]) - ord("a") + 1
        elif chr(c).isalpha():
            out[c] = 27 + ord(low[0]) % 3
        elif chr(c).isdigit():
            out[c] = OTHER
    return out


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of the characters kept, and the words: text number, start, end (rows of one array); their hashes.

    Signs are left out, so they neither end a word nor lie in it. A run of one-letter words, three or more, is one word.
    """
    codes = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = np.where(codes < 0x3000, _classes()[np.minimum(codes, 0x2FFF)], 27).astype(np.uint8)
    begins = np.cumsum([1, *(len(text) + 1 for text in texts)])
    owner = np.searchsorted(begins, np.arange(len(codes)), "right") - 1
    kept = kind != SIGN
    kind, owner = kind[kept], owner[kept]
    start, end = _runs(kind > 0)
    single = np.flatnonzero(end - start == 1)
    if len(single) > 2:  # spelled-out words: leave out the white space between their letters
        near = (np.diff(single) == 1) & (np.diff(owner[start[single]]) == 0) & (np.diff(start[single]) <= 3)
        head, tail = _runs(np.concatenate([[False], near, [False]]))
        kept = np.ones(len(kind), bool)
        for a, b in zip(head - 1, tail - 1):
            if b - a >= 2:
                kept[start[single[a]] : end[single[b]]] = False
                kept[start[single[a : b + 1]]] = True
        kind, owner = kind[kept], owner[kept]
        start, end = _runs(kind > 0)
    letters = np.concatenate([[0], np.cumsum((kind > 0) & (kind < EDGE))])
    has = letters[end] > letters[start]
    start, end = start[has], end[has]
    up, down = _powers(len(kind))
    total = np.concatenate([[np.uint64(0)], np.cumsum((kind.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64), 21)
    return kind, np.stack([owner[start], start, end]), hashes


def _runs(there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; the first and last value are false."""
    change = np.flatnonzero(there[1:] != there[:-1]) + 1
    return change[::2], change[1::2]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    from relayout.llm import arrow_text

    return arrow_text._powers(n)


def matrix(kind: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of words as rows of classes with edges, 0 beyond the end; and the word of each row."""
    pieces = np.maximum(1, -(-(end - start - WIDTH) // STRIDE) + 1)
    word = np.repeat(np.arange(len(start)), pieces)
    step = np.arange(len(word)) - (np.cumsum(pieces) - pieces)[word]
    begin = start[word] + step * STRIDE
    size = np.minimum(WIDTH, end[word] - begin)
    at = np.arange(WIDTH)
    inside = at < size[:, None]
    body = kind[np.minimum(begin[:, None] + at, len(kind) - 1)]
    body = np.where(body == 0, OTHER, body)
    rows = np.zeros((len(word), WIDTH + 2), np.uint8)
    rows[:, 0] = np.where(step == 0, EDGE, OTHER)
    rows[:, 1:-1] = np.where(inside, body, 0)
    last = step == pieces[word] - 1
    rows[np.arange(len(word)), size + 1] = np.where(last, EDGE, OTHER)
    return rows, word


def subsequences(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.float32]]:
    """Feature number, whether it is there, and weight, for every place and gap of each row."""
    wide = rows.astype(np.int32)
    n = rows.shape[1]
    for a, b, c in _GAPS:
        last = wide[:, c:]
        feature = (wide[:, : n - c] << 15) | (wide[:, a : n - c + a] << 10) | (wide[:, b : n - c + b] << 5) | last
        yield feature, last > 0, np.float32(DECAY ** (c + 1))


def values(rows: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The normalised sum of each row's subsequences' weights."""
    total, norm = np.zeros(len(rows), np.float32), np.zeros(len(rows), np.float32)
    for feature, there, weight in subsequences(rows):
        total += weight * np.where(there, table[feature], 0).sum(1)
        norm += weight * weight * there.sum(1)
    return total / np.sqrt(np.maximum(norm, 1e-6))


class Landmarks(NamedTuple):
    """Landmark words as feature vectors: the line of each feature (0: in none of them), and the vectors, by line."""

    line: np.ndarray
    vectors: np.ndarray


def landmarks(rows: np.ndarray) -> Landmarks:
    """The normalised feature vectors of some rows."""
    seen = [np.unique(feature[there]) for feature, there, _ in subsequences(rows)]
    used = np.unique(np.concatenate(seen))
    line = np.zeros(ALPHABET**4, np.int32)
    line[used] = np.arange(1, len(used) + 1)
    vectors = np.zeros((len(used) + 1, len(rows)), np.float32)
    norm = np.zeros(len(rows), np.float32)
    column = np.arange(len(rows))[:, None]
    for feature, there, weight in subsequences(rows):
        np.add.at(vectors, (line[feature[there]], np.broadcast_to(column, feature.shape)[there]), weight)
        norm += weight * weight * there.sum(1)
    return Landmarks(line, vectors / np.sqrt(np.maximum(norm, 1e-6)))


def kernel(rows: np.ndarray, line: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Normalised products of rows with the columns of ``weights``, which has one line per known feature."""
    out = np.zeros((len(rows), weights.shape[1]), np.float32)
    for a in range(0, len(rows), 256):
        part = rows[a : a + 256]
        norm = np.zeros(len(part), np.float32)
        for feature, there, weight in subsequences(part):
            at = np.where(there, line[feature], 0)
            row, place = np.nonzero(at)
            if len(row):
                first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                out[a + row[first]] += weight * np.add.reduceat(weights[at[row, place]], first, axis=0)
            norm += weight * weight * there.sum(1)
        out[a : a + 256] /= np.sqrt(np.maximum(norm, 1e-6))[:, None]
    return out


def support_vectors(z: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps over the examples inside the margin."""
    x = np.hstack([z, np.ones((len(z), 1), np.float32)]).astype(np.float64)
    ridge = np.full(x.shape[1], RIDGE)
    ridge[-1] = 0
    weight = (weight / weight.sum()).astype(np.float64)
    w = np.zeros(x.shape[1])

    def loss(w: np.ndarray) -> float:
        slack = np.maximum(0, 1 - y * (x @ w))
        return float(weight @ slack**2 + ridge @ w**2)

    for _ in range(rounds):
        inside = y * (x @ w) < 1
        part = x[inside] * weight[inside, None]
        step = np.linalg.solve(part.T @ x[inside] + np.diag(ridge + 1e-12), part.T @ y[inside]) - w
        size, now = 1.0, loss(w)
        while size > 1e-3 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if now - loss(w) < 1e-7 * max(now, 1e-12):
            break
    return w[:-1].astype(np.float32), float(w[-1])


class Model(NamedTuple):
    table: np.ndarray
    shift: float
    slope: float
    middle: float


def _altered(rows: np.ndarray, seed: np.random.Generator) -> np.ndarray:
    """The rows with one class put in, or one put between all letters, where the width allows."""
    out = []
    for row in rows:
        body = row[1 : int(np.flatnonzero(row)[-1])]
        place = int(seed.integers(1, max(2, len(body))))
        once = np.insert(body, place, seed.integers(1, 32))
        every = np.insert(body, np.arange(1, len(body)), OTHER)
        for new in (once, every):
            if len(new) <= WIDTH:
                made = np.zeros_like(row)
                made[0], made[1 : len(new) + 1], made[len(new) + 1] = EDGE, new, EDGE
                out.append(made)
    return np.array(out, np.uint8).reshape(-1, rows.shape[1])


def evidence(in_toxic: np.ndarray, in_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Twice the log-likelihood that a word's toxic texts are no chance, negative where it prefers clean ones."""
    def part(k: np.ndarray, n: float, rate: np.ndarray) -> np.ndarray:
        rate = np.clip(rate, 1e-9, 1 - 1e-9)
        return k * np.log(rate) + (n - k) * np.log(1 - rate)

    both = (in_toxic + in_clean) / (toxic + clean)
    apart = part(in_toxic, toxic, in_toxic / toxic) + part(in_clean, clean, in_clean / clean)
    together = part(in_toxic, toxic, both) + part(in_clean, clean, both)
    return 2 * (apart - together) * np.sign(in_toxic / toxic - in_clean / clean)


def without_copies(texts: list[str], labels: np.ndarray) -> tuple[list[str], np.ndarray]:
    """One text of each group of near copies, found by the least hashes of their rarer words.

    Copies of one toxic text would make all its words look toxic.
    """
    _, spans, hashes = words(texts)
    pair = np.unique(np.stack([hashes, spans[0].astype(np.uint64)]), axis=1)
    _, word, often = np.unique(pair[0], return_inverse=True, return_counts=True)
    rare = often[word] <= max(3, len(texts) // 20)
    seen: set[tuple[int, int]] = set()
    keep = np.ones(len(texts), bool)
    least = []
    for k in range(3):
        value = np.full(len(texts), np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(value, pair[1][rare].astype(np.int64), mix(pair[0][rare], 31 + k))
        least.append(value)
    for i in range(len(texts)):
        keys = {(k, int(value[i])) for k, value in enumerate(least) if value[i] != np.iinfo(np.uint64).max}
        keep[i] = not keys & seen
        seen |= keys
    if labels[keep].min() == labels[keep].max():
        return texts, labels
    return [text for text, kept in zip(texts, keep) if kept], labels[keep]


def fit(texts: list[str], labels: np.ndarray) -> Model | None:
    """The model from labelled texts; None where a class is missing."""
    if not len(texts) or labels.min() == labels.max():
        return None
    seed = np.random.default_rng(7)
    texts, labels = without_copies(texts, labels)
    kind, spans, hashes = words(texts)
    unique, first, word = np.unique(hashes, return_index=True, return_inverse=True)
    rows, owner = matrix(kind, spans[1][first], spans[2][first])
    head = rows[np.searchsorted(owner, np.arange(len(unique)))]  # the first window of each word
    toxic = labels == 1
    pair = np.unique((spans[0].astype(np.int64) << 32) | word)  # each word once per text
    text, word = pair >> 32, pair & 0xFFFFFFFF
    in_toxic = np.bincount(word[toxic[text]], minlength=len(unique))
    in_clean = np.bincount(word[~toxic[text]], minlength=len(unique))
    proof = evidence(in_toxic, in_clean, toxic.sum(), (~toxic).sum())
    telling = (in_toxic / toxic.sum()) > 20 * (in_clean / (~toxic).sum())
    pool = np.flatnonzero(telling)
    pool = pool[np.argsort(-proof[pool], kind="stable")][:NEGATIVES]
    strong = proof[pool] >= 2 * np.log(len(unique)) + 4
    clean = np.flatnonzero((in_clean > 0) & ~telling)
    clean = clean[np.argsort(-in_clean[clean] + seed.random(len(clean)), kind="stable")]
    common, rest = clean[: NEGATIVES // 3], clean[NEGATIVES // 3 :]
    clean = np.concatenate([common, seed.permutation(rest)[: NEGATIVES - len(common)]])
    bad = pool[: LANDMARKS // 2]
    line, phi = landmarks(head[bad])
    close = np.argsort(-kernel(head[clean], line, phi).max(1), kind="stable")  # the hardest clean words, and any
    mixed = np.concatenate([close[: LANDMARKS // 4], seed.permutation(close[LANDMARKS // 4 :])[: LANDMARKS // 4]])
    landmark = np.concatenate([bad, clean[mixed]])
    line, phi = landmarks(head[landmark])
    value, vector = np.linalg.eigh(phi.T @ phi + 1e-3 * np.eye(len(landmark), dtype=np.float32))
    root = (vector / np.sqrt(np.maximum(value, 1e-3))).astype(np.float32)
    projected = phi @ root  # subsequences to the landmarks' space
    positive, negative = kernel(head[pool], line, projected), kernel(head[clean], line, projected)
    where = np.full(len(unique), -1)
    where[pool] = np.arange(len(pool))
    mine = toxic[text] & (where[word] >= 0)
    bag, inside = text[mine], where[word[mine]]
    explained = np.zeros(len(texts), bool)
    explained[bag[strong[inside]]] = True
    weight_negative = np.sqrt(in_clean[clean]).astype(np.float32)
    score = proof[pool] / (2 * np.log(len(unique)))
    for _ in range(ALTERNATIONS):
        # the words chosen: all that are proved, and the worst one of each toxic text that has none
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, bag, score[inside])
        top = ~explained[bag] & (score[inside] >= best[bag] - 1e-6)
        worst = np.unique(inside[top])
        chosen = np.unique(np.concatenate([np.flatnonzero(strong), worst]))
        more = _altered(head[pool[chosen]], seed)
        held = in_toxic[pool[chosen]].astype(np.float32) ** 0.5
        altered = np.repeat(held, 2)[: len(more)]
        z = np.vstack([positive[chosen], kernel(more, line, projected), negative])
        y = np.concatenate([np.ones(len(chosen) + len(more)), -np.ones(len(negative))]).astype(np.float32)
        weight = np.concatenate(
            [held / held.sum(), 0.7 * altered / max(1e-9, altered.sum()), 2 * weight_negative / weight_negative.sum()]
        ).astype(np.float32)
        w, shift = support_vectors(z, y, weight)
        table = (projected @ w).astype(np.float32)[line]
        score = positive @ w + shift + 0.25 * proof[pool] / (2 * np.log(len(unique)))
    bags = text_values(texts, table, shift)
    middle, gap = cut(bags[toxic], bags[~toxic])
    return Model(table, shift, 4.0 / gap, middle)


def cut(good: np.ndarray, bad: np.ndarray) -> tuple[float, float]:
    """The value that parts the toxic texts' values from the clean ones' with fewest errors, and the gap around it."""
    good, bad = np.sort(good[np.isfinite(good)]), np.sort(bad[np.isfinite(bad)])
    if not len(good) or not len(bad):
        return 0.0, 1.0
    at = np.unique(np.concatenate([good, bad]))
    middles = np.concatenate([(at[1:] + at[:-1]) / 2, at[-1:] + 0.1])
    missed = np.searchsorted(good, middles) / len(good)
    wrong = 1 - np.searchsorted(bad, middles) / len(bad)
    cost = missed + 4 * wrong
    fine = np.flatnonzero(cost <= cost.min() + 1e-9)
    middle = float(middles[fine[len(fine) // 2]])
    above, below = good[good > middle], bad[bad < middle]
    gap = (np.median(above) if len(above) else middle + 1) - (np.quantile(below, 0.9) if len(below) else middle - 1)
    return middle, float(max(gap, 0.1))


def text_values(texts: list[str], table: np.ndarray, shift: float) -> np.ndarray:
    """The machine's value of each text: its worst word's; -inf without words."""
    kind, spans, hashes = words(texts)
    out = np.full(len(texts), -np.inf)
    if len(hashes):
        _, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        rows, owner = matrix(kind, spans[1][first], spans[2][first])
        each = np.full(len(first), -np.inf)
        for a in range(0, len(rows), 1 << 15):
            found = values(rows[a : a + (1 << 15)], table) + shift
            np.maximum.at(each, owner[a : a + (1 << 15)], found)
        np.maximum.at(out, spans[0], each[word])
    return out


def probability(value: np.ndarray, model: Model) -> np.ndarray:
    """0 to 1; 0.7 at the middle between the classes."""
    at = np.clip(model.slope * (value - model.middle) + np.log(0.7 / 0.3), -60, 60)
    return np.where(np.isfinite(value), 1 / (1 + np.exp(-at)), 0.0)


def training_texts(docs: DataFrame, labels: DataFrame, learn: Column) -> tuple[list[str], np.ndarray]:
    """A bounded sample of labelled texts, by a hash of the id."""
    marked = labels.where(learn & F.col("label").isin(0, 1)).select("doc_id", "label")
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {row["label"]: row["count"] for row in marked.groupBy("label").count().collect()}
    most = {1: TRAINING_TOXIC, 0: TRAINING_CLEAN}
    share = F.lit(0)
    for label, size in sizes.items():
        share = F.when(F.col("label") == label, F.lit(int(1_000_000 * min(1.0, most[label] / size)))).otherwise(share)
    picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    rows = docs.join(F.broadcast(picked), "doc_id").select("doc_id", "label", "text").orderBy("doc_id").toArrow()
    return [t or "" for t in rows.column("text").to_pylist()], np.array(rows.column("label").to_pylist(), int)


def score_texts(
    docs: DataFrame, labels: DataFrame, learn: Column, id_column: str = "doc_id", text: str = "text",
    label: str = "toxic",
) -> DataFrame:
    """doc_id and score of every row; ``learn`` says, on doc_id, which labels may be learned from."""
    spark = docs.sparkSession
    prepare(spark)
    read = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    marked = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
    model = spark.sparkContext.broadcast(fit(*training_texts(read, marked, learn)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [value or "" for value in part.column("text").to_pylist()]
                found = np.zeros(len(texts))
                if model.value is not None:
                    found = probability(text_values(texts, model.value.table, model.value.shift), model.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    kind = read.schema["doc_id"].dataType.simpleString()
    return read.mapInArrow(score, f"doc_id {kind}, score double")
