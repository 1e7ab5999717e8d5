"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

Documents are partitioned by the size of their shingle set. Within a partition each is sketched by one-permutation
MinHash: the hash space is cut into bins, as many as the partition's largest set divided by a load, and each
bin keeps its least hash. A test item is sketched with the bins of each partition. A shingle that a document
shares with an item is the least of its bin on both sides with a probability set by the load alone, however long
the document is, so the chance to miss an item of q shingles at the wanted containment can be tuned: the
load is the largest that keeps it under MISS for the smallest item sketched. Items of so few shingles that no load down
to FINEST keeps to MISS (one or two, at the wanted containment) are not sketched: their shingles meet all those of the
documents. Pairs that agree in a bin, or share enough shingles of such an item, are candidates, and the shingles
themselves, as text, decide.

Only DataFrame functions run here. Item sketches and the shingles of items with few are broadcast only up to BROADCAST_ROWS rows, counted before;
beyond that Spark shuffles both sides.

Defined cases. Null or empty texts and items: no shingles, so no pairs. Fewer than five words: the whole sequence
is the one shingle, so such an item matches texts that are nothing else, not passages. Repeated rows and equal ids: one pair, with the highest containment. Null ids: kept. No rows on
either side: no pairs. Other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayout.llm.shared import stored

WORDS = 5
CONTAINMENT = 0.8
#: Chance to miss the smallest sketched item at the wanted containment.
MISS = 1e-6
#: The least load of a bin; items that would need less are joined on all shingles.
FINEST = 1 / 64
#: Item sketch rows (some 30 bytes each) and candidate pairs that may be broadcast.
BROADCAST_ROWS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of a text, A-Z as a-z."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(lower, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def shingle_hashes(hashes: Column, size: int = WORDS) -> Column:
    """Hashes of the shingles, ascending and distinct, from the hashes of the words."""
    starts = F.sequence(F.lit(0), F.size(hashes) - F.lit(size))
    many = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + F.lit(k)) for k in range(size)]))
    few = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.sort_array(F.array_distinct(F.when(F.size(hashes) >= size, many).otherwise(few)))


def shingle_texts(found: Column, size: int = WORDS) -> Column:
    """The distinct shingles themselves."""
    starts = F.sequence(F.lit(0), F.size(found) - F.lit(size))
    many = F.transform(starts, lambda i: F.array_join(F.slice(found, i + 1, F.lit(size)), " "))
    few = F.when(F.size(found) > 0, F.array(F.array_join(found, " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.size(found) >= size, many).otherwise(few))


def _chance(load: float) -> float:
    """Chance of a shingle not to be the least of a bin with so many others."""
    return 1 - (1 - math.exp(-load)) / load


def least_shared(miss: float = MISS) -> int:
    """The fewest shared shingles of which one is found with a chance of all but ``miss`` at the finest load."""
    return math.ceil(math.log(miss) / math.log(_chance(FINEST)))


def tuned_load(smallest: int, containment: float = CONTAINMENT, miss: float = MISS) -> float:
    """The most shingles a bin may hold on average so that the smallest item is missed with probability ``miss``."""
    shared = max(1, math.ceil(containment * smallest))
    load = 8.0
    while load > FINEST:
        if _chance(load) ** shared <= miss:
            return load
        load /= 2
    return load


def _bins(size: Column, load: float) -> Column:
    """log2 of the number of bins for the size partition of a set."""
    step = math.ceil(-math.log2(load))
    return F.greatest(F.lit(0), F.least(F.lit(62), F.ceil(F.log2(size.cast("double"))).cast("int") + F.lit(step)))


def bin_minima(hashes: Column, bits: Column) -> Column:
    """The least hash of each bin, from ascending hashes; the high bits of a hash are its bin."""
    # shifting by 64 would shift by 0, so no bins (one bin) is a case of its own
    first = F.filter(
        hashes,
        lambda x, i: (i == 0)
        | (F.call_function("shiftright", x, F.lit(64) - bits) != F.call_function("shiftright", F.get(hashes, i - 1), F.lit(64) - bits)),
    )
    return F.when(bits > 0, first).otherwise(F.slice(hashes, 1, 1))


def _within(rows: DataFrame, most: int) -> bool:
    """Whether a frame has at most ``most`` rows, by counting no more than one beyond."""
    return rows.limit(most + 1).count() <= most


def contained_items(
    docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, size: int = WORDS,
    id_column: str = "doc_id", item_id: str = "item_id", text: str = "text",
) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment of every pair at or above the wanted containment."""
    item_words = items.select(F.col(item_id).alias("item_id"), words(F.col(text)).alias("words"))
    item_hashes = item_words.select("item_id", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    sets = item_hashes.select("item_id", "words", shingle_hashes(F.col("h"), size).alias("set"))
    # no filter on the arrays: pushed below their projections, it would compute them again for every element
    wanted = F.greatest(F.lit(1), F.ceil(F.lit(containment) * F.size("set")))
    few = wanted < least_shared()
    there = F.size("set") > 0
    smallest, n_few = sets.agg(F.min(F.when(there & ~few, F.size("set"))), F.count_if(there & few)).first()
    load = tuned_load(smallest, containment) if smallest else 8.0

    read = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    found = read.select("doc_id", F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    found = found.select("doc_id", shingle_hashes(F.col("h"), size).alias("set"))
    sketches = found.select("doc_id", "set", _bins(F.size("set"), load).alias("bits"))
    sketches = sketches.select("doc_id", "bits", F.explode(bin_minima(F.col("set"), F.col("bits"))).alias("hash"))

    # an item's row lists the partitions in which a shingle is the least of its bin
    step = math.ceil(-math.log2(load))
    every = F.sequence(F.lit(max(0, step)), F.lit(min(62, 40 + step)))
    by_bits = sets.select("item_id", "set", F.explode(F.when(~few, every)).alias("bits"))
    least = by_bits.select("item_id", "bits", F.explode(bin_minima(F.col("set"), F.col("bits"))).alias("hash"))
    index = least.groupBy("item_id", "hash").agg(F.collect_set("bits").alias("in_bits"))
    if _within(index, BROADCAST_ROWS):
        index = F.broadcast(index)
    agree = sketches.join(index, "hash").where(F.array_contains("in_bits", F.col("bits")))
    candidates = agree.select("doc_id", "item_id").distinct()
    if n_few:
        candidates = candidates.unionByName(_sharing(found, sets.withColumns({"wanted": wanted, "few": few})))

    return verified(read, sets, candidates, containment, size)


def _sharing(found: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs of documents and items with few shingles that share as many as wanted."""
    asked = sets.select("item_id", "wanted", F.explode(F.when(F.col("few"), F.col("set"))).alias("hash")).distinct()
    if _within(asked, BROADCAST_ROWS):
        asked = F.broadcast(asked)
    # an expression, for Spark infers a filter on an array column that is exploded as it is
    each = found.select("doc_id", F.explode(F.transform("set", lambda x: x)).alias("hash"))
    shared = each.join(asked, "hash").groupBy("doc_id", "item_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("wanted").alias("wanted")
    )
    return shared.where("n >= wanted").select("doc_id", "item_id")


def verified(
    read: DataFrame, sets: DataFrame, candidates: DataFrame, containment: float, size: int
) -> DataFrame:
    """The candidate pairs whose exact containment reaches the wanted one."""
    pairs = stored(candidates.withColumnsRenamed({"doc_id": "c_doc", "item_id": "c_item"}), "benchmark-candidates")
    ids = pairs.select("c_doc").distinct()
    if _within(ids, BROADCAST_ROWS):
        ids = F.broadcast(ids)
    texts = read.join(ids, read["doc_id"].eqNullSafe(ids["c_doc"]), "left_semi")
    texts = texts.select("doc_id", words(F.col("text")).alias("words"))
    texts = texts.select("doc_id", shingle_texts(F.col("words"), size).alias("in_doc"))
    wanted = sets.select("item_id", "words")
    wanted = wanted.select("item_id", shingle_texts(F.col("words"), size).alias("in_item"))
    asked = pairs.join(wanted, pairs["c_item"].eqNullSafe(wanted["item_id"]))
    both = asked.join(texts, asked["c_doc"].eqNullSafe(texts["doc_id"]))
    shared = both.select(
        "doc_id", "item_id", F.size("in_item").cast("long").alias("n_item"),
        F.size(F.array_intersect("in_item", "in_doc")).cast("long").alias("n_shared"),
    )
    best = shared.groupBy("doc_id", "item_id").agg(
        F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("best")
    )
    best = best.select("doc_id", "item_id", "best.n_shared", "best.n_item")
    share = F.col("n_shared") / F.col("n_item")
    return best.withColumn("containment", share).where(share >= containment)


def uncontaminated(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that hold no benchmark item. Rows with a null id are judged together."""
    hit = stored(contained_items(docs, items, containment).select(F.col("doc_id").alias("__hit")).distinct(), "hits")
    if _within(hit, BROADCAST_ROWS):
        hit = F.broadcast(hit)
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__hit"]), "left_anti")
