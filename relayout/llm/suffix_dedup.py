"""Removal of repeated byte strings over a whole corpus, by suffix arrays of the places that can repeat.

A byte is removed if a string of WINDOW bytes over it also starts earlier: in a smaller document, or before in
the same one. One suffix array of a corpus fits no machine, so equal windows are first brought together. Every
window has an anchor, the place of its least GRAM-byte hash; equal windows have their anchors at the same
offset. Neighbouring windows mostly share one, and form a context: the text from the first of them to the end of the last.
A context whose anchor occurs nowhere else holds no repeat and goes no further. Of equal contexts the first keeps
its place and the others are repeats as a whole. Different contexts of one anchor are sorted together: suffix
arrays by two-stage sorting, repeats from the common prefixes of neighbours. Only anchors (40 bytes for each 40
bytes of text) and the differing contexts are shuffled.

An anchor with more than GROUP contexts (a phrase that very many texts share, each in other company) is not sorted
in one task: its windows are aggregated by hash instead, so no group is unbounded.

Equal texts are one text: the first document of them keeps it, others lose all of a text of WINDOW bytes or more.

Defined cases. Null and empty texts, and texts shorter than the window: nothing removed. Repeated rows (same id and
text) are one document, each with its result. Rows of one id with different texts, and null ids (after all others), are
ordered by a hash of the text. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayout.llm import arrow_text
from relayout.llm.arrow_text import buffers, mix, slices
from relayout.llm.shared import prepare, stored
from relayout.llm.suffix_sort import earlier_equals

WINDOW = 100
GRAM = 24
#: Contexts of one anchor that are sorted together.
GROUP = 20_000
#: Bytes of contexts that one suffix array covers, about.
SORTED_BYTES = 1 << 20
#: Ids of documents (some 200 bytes each as a hash table) that may be broadcast.
BROADCAST_IDS = 250_000
#: Bytes of one text looked at in a round.
SECTION = 1 << 20

_VALUE = mix(np.arange(256, dtype=np.uint64), 91)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Contexts of all texts: text number, anchor hash, context hash, place of the first window, number of windows."""
    found: list[tuple[np.ndarray, ...]] = []
    inside = window - gram + 1
    for a in range(0, max(0, len(data) - window + 1), SECTION):
        part = data[a : min(len(data), a + SECTION + window - 1)]
        n = len(part)
        up, down = arrow_text._powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[part] * up[:n], out=total[1:])
        grams = total[gram:] - total[:-gram]
        grams *= down[: n - gram + 1]
        grams ^= grams >> np.uint64(29)
        grams *= np.uint64(0x9FB21C651E98DF25)
        grams ^= grams >> np.uint64(32)
        place = np.arange(len(grams), dtype=np.uint64)
        least = _sliding_least((grams & np.uint64(0xFFFFFFFFFF000000)) | place, inside)
        # a run of windows ends where the anchor changes, and where a text does
        new = np.ones(len(least), bool)
        np.not_equal(least[1:], least[:-1], out=new[1:])
        new[offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, a + len(least))] - a] = True
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(least)]]) - 1
        text = np.searchsorted(offsets, first + a, "right") - 1
        last = np.minimum(last, offsets[text + 1] - a - window)
        kept = first <= last
        first, last, text = first[kept], last[kept], text[kept]
        if not len(first):
            continue
        anchor = (least[first] & np.uint64(0xFFFFFF)).astype(np.int64)
        shape = ((anchor - first) << 8 | (last - first)).astype(np.uint64)
        context = mix(((total[last + window] - total[first]) * down[first]) ^ mix(shape, 93), 94)
        found.append((text, grams[anchor], context, first + a - offsets[text], last - first + 1))
    if not found:
        return tuple(np.zeros(0, kind) for kind in (np.int64, np.uint64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(column) for column in zip(*found))


def _text_hashes() -> list[Column]:
    return [F.xxhash64(F.col("text")).alias("t1"), F.xxhash64(F.lit("2"), F.col("text")).alias("t2")]


def contexts(read: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, context, t1, t2 (the text's hashes), at (first window), windows and more: of each text of a task.

    Equal contexts of a text are one row; ``more`` has the places of all but the first (null if it is the only one).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text", SECTION):
                t1, t2 = part.column("t1").to_numpy(), part.column("t2").to_numpy()
                new = []
                for i, name in enumerate(zip(t1.tolist(), t2.tolist())):
                    if name not in seen:
                        seen.add(name)
                        new.append(i)
                texts = part.column("text").take(pa.array(new, pa.int64()))
                found = anchors(*buffers(texts), window, gram)
                order = np.lexsort((found[3], found[2], found[1], found[0]))
                text, anchor, context, at, windows = (column[order] for column in found)
                if not len(text):
                    continue
                again = (text[1:] == text[:-1]) & (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
                first = np.flatnonzero(np.concatenate([[True], ~again]))
                times = np.diff(np.concatenate([first, [len(text)]]))
                rest = np.ones(len(text), bool)
                rest[first] = False
                ends = np.concatenate([[0], np.cumsum(times - 1)]).astype(np.int32)
                more = pa.ListArray.from_arrays(
                    pa.array(ends), pa.array(at[rest]), mask=pa.array(times == 1)
                )
                row = np.array(new, np.int64)[text[first]]
                columns = [anchor[first].view(np.int64), context[first].view(np.int64), t1[row], t2[row]]
                columns += [at[first], windows[first]]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(column) for column in columns), more],
                    ["anchor", "context", "t1", "t2", "at", "windows", "more"],
                )

    long = read.where(F.octet_length("text") >= window).select("text", *_text_hashes())
    return long.mapInArrow(cut, "anchor long, context long, t1 long, t2 long, at long, windows long, more array<long>")


def _sort_groups(window: int):
    """Flagged windows, as runs, of contexts that come ordered by anchor."""
    kind = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])

    def flagged(table: pa.Table) -> pa.RecordBatch:
        data, offsets = buffers(table.column("bytes"))
        starts, ends = offsets[:-1], offsets[1:]
        columns = {name: table.column(name).to_numpy() for name in ("none", "doc", "t1", "t2", "at", "windows")}
        order = np.lexsort([columns[name] for name in ("at", "t2", "t1", "doc", "none")])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        flags = earlier_equals(data.tobytes(), starts, ends, window, columns["windows"], rank)
        change = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
        first, last = change[::2], change[1::2] - 1
        row = np.searchsorted(offsets, first, "right") - 1
        shift = columns["at"][row] - starts[row]
        arrays = [columns["t1"][row], columns["t2"][row], first + shift, last + shift]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in arrays], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.nbytes
            if size < SORTED_BYTES:
                continue
            table = pa.Table.from_batches(held)
            name = table.column("anchor").to_numpy()
            cut = int(np.searchsorted(name, name[-1], "left"))  # the last anchor may go on in the next batch
            if cut:
                yield flagged(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            size = sum(one.nbytes for one in held)
        if held:
            yield flagged(pa.Table.from_batches(held))

    return run


def _within(rows: DataFrame, most: int) -> bool:
    return rows.limit(most + 1).count() <= most


def _texts_of(read: DataFrame, names: DataFrame, first: DataFrame) -> DataFrame:
    """t1, t2, text of the texts named by t1, t2 in ``names``, from the first document that has each."""
    wanted = first.join(names.select("t1", "t2").distinct(), ["t1", "t2"], "left_semi").select("t1", "t2", "id")
    ids = wanted.select(F.col("id").alias("wanted_id")).distinct()
    if _within(ids, BROADCAST_IDS):
        ids = F.broadcast(ids)
    texts = read.join(ids, read["doc_id"].eqNullSafe(ids["wanted_id"]), "left_semi").select("text", *_text_hashes())
    return texts.join(wanted.select("t1", "t2"), ["t1", "t2"], "left_semi").dropDuplicates(["t1", "t2"])


def repeats(read: DataFrame, first: DataFrame, window: int, gram: int) -> DataFrame:
    """t1, t2, first, last: runs of window starts that also start earlier. first: t1, t2, none, doc, id."""
    every = contexts(read, window, gram)
    place = F.xxhash64("t1", "t2", "at")
    seen = every.groupBy("anchor").agg(
        F.min(place).alias("a"), F.max(place).alias("b"), F.count("more").alias("inside")
    )
    twice = seen.where("a <> b OR inside > 0").select("anchor")
    # rows of equal texts from several tasks stay: they fall together below, and a hot anchor's join can be split
    found = every.join(twice, "anchor", "left_semi").join(first.drop("id"), ["t1", "t2"])
    found = stored(found, "repeated-anchors")
    within = found.select("t1", "t2", "windows", F.explode("more").alias("first"))
    within = within.select("t1", "t2", "first", (F.col("first") + F.col("windows") - 1).alias("last"))

    key = ["none", "doc", "t1", "t2", "at"]
    lead = found.groupBy("anchor", "context").agg(F.min(F.struct(*key)).alias("lead"), F.first("windows").alias("w"))
    lead = stored(lead, "first-contexts")
    same = found.join(lead.select("anchor", "context", "lead"), ["anchor", "context"])
    later = same.where(F.struct(*key) != F.col("lead")).select(
        "t1", "t2", F.col("at").alias("first"), (F.col("at") + F.col("windows") - 1).alias("last")
    )

    differ = lead.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    mixed = lead.join(differ, "anchor").select("anchor", "n", "lead.*", F.col("w").alias("windows"))
    texts = _texts_of(read, mixed, first)
    taken = texts.join(
        mixed.groupBy("t1", "t2").agg(
            F.collect_list(F.struct("anchor", "n", "none", "doc", "at", "windows")).alias("places")
        ),
        ["t1", "t2"],
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = buffers(part.column("text"))
                lists = part.column("places")
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                flat = lists.flatten()
                fields = {name: flat.field(name) for name in ("anchor", "n", "none", "doc", "at", "windows")}
                begin = offsets[row] + fields["at"].to_numpy()
                size = fields["windows"].to_numpy() + window - 1
                ends = np.cumsum(size)
                at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)
                edges = np.concatenate([[0], ends]).astype(np.int32)
                body = pa.Array.from_buffers(
                    pa.binary(), len(row), [None, pa.py_buffer(edges), pa.py_buffer(data[at].tobytes())]
                )
                names = [pa.array(part.column(name).to_numpy()[row]) for name in ("t1", "t2")]
                yield pa.RecordBatch.from_arrays([*fields.values(), *names, body], [*fields, "t1", "t2", "bytes"])

    schema = "anchor long, n long, none boolean, doc long, at long, windows long, t1 long, t2 long, bytes binary"
    cuts = stored(taken.mapInArrow(cut, schema), "differing-contexts")
    small = cuts.where(F.col("n") <= GROUP).repartition("anchor").sortWithinPartitions("anchor")
    by_sorting = small.mapInArrow(_sort_groups(window), "t1 long, t2 long, first long, last long")
    return later.unionByName(within).unionByName(by_sorting).unionByName(_by_hash(cuts.where(F.col("n") > GROUP), window))


def _by_hash(cuts: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many contexts: windows aggregated by two hashes."""
    each = cuts.withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1)))
    part = F.substring("bytes", (F.col("step") + 1).cast("int"), F.lit(window))
    each = each.select(
        "none", "doc", "t1", "t2", (F.col("at") + F.col("step")).alias("at"),
        F.xxhash64(part).alias("h1"), F.xxhash64(F.lit("2"), part).alias("h2"),
    )
    key = F.struct("none", "doc", "t1", "t2", "at")
    least = each.groupBy("h1", "h2").agg(F.min(key).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = each.join(least, ["h1", "h2"]).where(key != F.col("lead"))
    return later.select("t1", "t2", F.col("at").alias("first"), F.col("at").alias("last"))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed byte ranges, end exclusive) of every row.

    Ids must be integers. Where a text is a later copy as a whole, its one span is the whole text.
    """
    prepare(docs.sparkSession)
    read = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    rows = read.select(
        "doc_id", *_text_hashes(), F.octet_length("text").cast("long").alias("n_bytes"),
        F.sha2("text", 256).alias("sha"),
    )
    rows = stored(rows, "texts")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc"))
    first = rows.groupBy("t1", "t2").agg(F.min(order).alias("lead"))
    owner = F.when(~F.col("lead.none"), F.col("lead.doc"))
    first = stored(first.select("t1", "t2", "lead.none", "lead.doc", owner.alias("id")), "first-documents")

    runs = repeats(read, first, window, gram).groupBy("t1", "t2")
    runs = stored(runs.agg(F.collect_list(F.struct("first", "last")).alias("runs")), "runs")
    texts = _texts_of(read, runs, first).join(runs, ["t1", "t2"])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = buffers(part.column("text"))
                spans, shas = [], []
                for i in range(part.num_rows):
                    body = data[offsets[i] : offsets[i + 1]]
                    run = part.column("runs")[i].values
                    change = np.zeros(len(body) + 1, np.int32)
                    np.add.at(change, run.field("first").to_numpy(), 1)
                    np.add.at(change, run.field("last").to_numpy() + window, -1)
                    gone = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
                    edge = np.flatnonzero(gone[1:] != gone[:-1])
                    spans.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
                    shas.append(hashlib.sha256(body[~gone[1:-1]].tobytes()).hexdigest())
                span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                columns = [part.column("t1"), part.column("t2"), pa.array(spans, span), pa.array(shas, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["t1", "t2", "spans", "kept"])

    span = "array<struct<start:bigint,end:bigint>>"
    stripped = texts.select("t1", "t2", "text", "runs").mapInArrow(
        strip, f"t1 long, t2 long, spans {span}, kept string"
    )
    out = rows.join(first.drop("none", "doc"), ["t1", "t2"]).join(stripped, ["t1", "t2"], "left")
    copy = ~F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("n_bytes") >= window)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    spans = F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast(span)))
    sha = F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha"))
    out = out.select("doc_id", "n_bytes", spans.alias("spans"), sha.alias("kept_sha256"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        "kept_sha256", "spans",
    )
