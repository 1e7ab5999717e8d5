"""N-gram Jaccard join by universe partition and pigeonhole, verified exactly.

A text's set is that of its word shingles, as 64-bit hashes. Sets are put into bands by size. Two sets of a band (or
of neighbouring ones) that reach the similarity differ in at most H shingles, so when a hash deals all shingles into
segments, few segments differ: with ``exact`` segments and ``near`` segments of weight 2, exact + 2 * near > H, either
an exact segment is equal in both sets or a near one differs by one shingle at most. A set is therefore indexed
by the contents of its segments, and for near segments also by each one-deletion neighbour. ``skip`` further exact
segments pay for leaving out, in each set, the ``skip`` lightest ones: equal segments are equally light in both
sets, so a common one is left. Empty and nearly empty segments, which everybody shares, disappear this way. How
many segments are exact, near and skipped is chosen per band by a cost of index rows and chance meetings, from the
measured number of sets in the band.

Equal sets are one node. Nodes that meet in a segment become candidates hub by hub: in each group the node with most
meetings is compared with all others, then the next ones, four times as many each round, and only with
nodes of other components. After the first round a pair is left out, too, if it must differ by too much: by
the shingles that only one of them has in the corpus, and by their differences to the hub, already counted. So a
group of copies costs a line, not a square, and yet no pair is left out unless its nodes are already connected or
cannot link. Before sets are fetched, parities sort out pairs: a set's parities say of some bits whether an even or odd
number of its shingles hash there, so each differing bit is a shingle that the two sets do not share. Exact
intersection of the sets decides the rest.

Defined cases. Null and empty texts, and texts without words: empty set, linked with nothing, their own component.
Fewer words than a shingle: the whole sequence is the one shingle. Repeated rows: equal sets, linked. Rows of one id
are one document for ``component_id`` purposes only if their sets are linked. Null ids: linked like others; a
component of null ids alone has a null id. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayout.llm.arrow_text import buffers, mix, shingle_sets, slices, word_hashes
from relayout.llm.components import contract
from relayout.llm.shared import prepare, stored, tidy

#: Ids of candidate documents (some 200 bytes each as a hash table) that may be broadcast.
BROADCAST_IDS = 250_000
#: Chance that a shingle of one text lies in another, unrelated one; for the cost of chance meetings only.
SHARED = 0.05
#: Index rows that a pair which meets by chance costs as much as, most of them being sorted out by parities.
PAIR_ROWS = 4
#: Members beyond which a group's pairs are bounded before they are made.
LARGE_GROUP = 32


class Bands:
    """Size bands for a similarity of ``num / den``, and the segments of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def bounds(self, largest: int) -> list[tuple[int, int]]:
        """First and last size of each band: as far as two steps of the similarity reach."""
        found, low = [], 1
        while low <= largest:
            high = low * self.den * self.den // (self.num * self.num)
            found.append((low, high))
            low = high + 1
        return found

    def differ(self, high: int) -> int:
        """Shingles in which a set of at most ``high`` and a larger similar one can differ."""
        return high * (self.den - self.num) // self.num

    def allocate(self, size: float, high: int, sets: int) -> tuple[int, int, int]:
        """Exact, near and skipped segments of least cost for ``sets`` sets of about ``size`` shingles."""
        need = self.differ(high) + 1
        best = (math.inf, (need, 0, 0))
        for near in sorted({0, 1, 2, need // 4, (need + 1) // 2}):
            for skip in sorted({0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, need // 8, need // 4}):
                exact = need + skip - 2 * near
                if exact < skip or exact + near < 1:
                    continue
                segments = exact + near
                load = size / segments
                rows = exact - skip + near * (1 + load)
                meet, light, before = 0.0, 0.0, 0.0
                chances = [math.exp(-load + c * math.log(max(load, 1e-9)) - math.lgamma(c + 1)) for c in range(9)]
                for c in range(8):
                    light += exact * chances[c]
                    left = _beyond(light, skip)
                    meet += (left - before) * chances[c] * SHARED**c
                    before = left
                    # a near segment meets others of its size, one less or one more, through any deletion
                    others = sum(chances[max(0, c - 1) : c + 2])
                    meet += near * chances[c] * others * (1 + c) ** 2 * SHARED ** max(0, c - 1)
                cost = rows + PAIR_ROWS * sets * meet
                best = min(best, (cost, (exact, near, skip)))
        return best[1]


def _beyond(mean: float, skip: int) -> float:
    """Expected number beyond ``skip`` of a Poisson count."""
    if mean > 60:
        return max(0.0, mean - skip)
    p, below, total = math.exp(-mean), 0.0, 0.0
    for k in range(skip):
        below += (skip - k) * p
        total += p
        p *= mean / (k + 1)
    return max(0.0, mean - skip + below)


def _sets(part: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    hashes, words = word_hashes(*buffers(part.column("text")))
    return shingle_sets(hashes, words, size)


def _names(key: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    out = []
    for seed in (51, 52):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(key, seed), dtype=np.uint64)])
        out.append(mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64), seed))
    return out[0].view(np.int64), out[1].view(np.int64)


def parities(key: np.ndarray, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """For each set a row of 64-bit words: whether an even or odd number of its shingles hash to each bit."""
    n = np.diff(first)
    base = np.concatenate([[0], np.cumsum(words)])
    owner = np.repeat(np.arange(len(n)), n)
    bit = mix(key, 61)
    word = base[owner] + ((bit >> np.uint64(6)) & (words[owner] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(word * 64 + (bit & np.uint64(63)).astype(np.int64), minlength=int(base[-1]) * 64) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def parity_words(number: np.ndarray, bands: Bands) -> np.ndarray:
    """Words of a set's parities: a power of two, three bits at least for each shingle that a similar set may lack."""
    differ = np.maximum(1, number * (bands.den - bands.num) // bands.num)
    return (1 << np.ceil(np.log2(np.maximum(1, differ / 20))).astype(np.int64)).astype(np.int64)


def differ_at_least(x: Column, y: Column) -> Column:
    """Shingles that two sets must differ by, from their parities: each one changes one bit."""
    width = F.least(F.size(x), F.size(y))

    def folded(a: Column, i: Column) -> Column:
        places = F.sequence(i, F.size(a) - 1, width)
        return F.aggregate(places, F.lit(0).cast("long"), lambda t, j: t.bitwiseXOR(F.get(a, j)))

    words = F.sequence(F.lit(0), width - 1)
    return F.aggregate(words, F.lit(0), lambda t, i: t + F.bit_count(folded(x, i).bitwiseXOR(folded(y, i))))


def signatures(key: np.ndarray, text: np.ndarray, texts: int, plan: np.ndarray, salt: np.ndarray):
    """Signatures of sets under a plan: (signature, text) arrays. plan: exact, near, skip of each text."""
    exact, near, skip = plan.T
    segments = exact + near
    base = np.concatenate([[0], np.cumsum(segments)])
    place = base[text] + (mix(key, 41) % segments[text].astype(np.uint64)).astype(np.int64)
    value = mix(key, 43)
    n = int(base[-1])
    load = np.bincount(place, minlength=n)
    low = np.bincount(place, (value & np.uint64(0xFFFFFFFF)).astype(float), n).astype(np.uint64)
    high = np.bincount(place, (value >> np.uint64(32)).astype(float), n).astype(np.uint64)
    owner = np.repeat(np.arange(texts), segments)
    number = np.arange(n) - base[owner]
    total = (high << np.uint64(32)) + low
    name = mix(number.astype(np.uint64) + (salt[owner].astype(np.uint64) << np.uint64(32)), 45)
    whole = mix(total + name, 47)
    # the lightest exact segments are left out; near ones come first in number
    is_exact = np.flatnonzero(number >= near[owner])
    order = is_exact[np.lexsort((whole[is_exact], load[is_exact], owner[is_exact]))]
    rank = np.arange(len(order)) - np.concatenate([[0], np.cumsum(exact)])[owner[order]]
    kept = order[rank >= skip[owner[order]]]
    near_whole = np.flatnonzero(number < near[owner])
    token = np.flatnonzero(number[place] < near[text])
    fewer = mix(total[place[token]] - value[token] + name[place[token]], 47)
    return (
        np.concatenate([whole[kept], whole[near_whole], fewer]).view(np.int64),
        np.concatenate([owner[kept], owner[near_whole], text[token]]),
    )


def text_sets(docs: DataFrame, size: int, bands: Bands) -> DataFrame:
    """doc_id, content, sid, chk (two hashes of the set), n (its size) and parities of every row."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                key, first = _sets(part, size)
                sid, chk = _names(key, first)
                words = parity_words(np.diff(first), bands)
                ends = pa.array(np.concatenate([[0], np.cumsum(words)]).astype(np.int32))
                odd = pa.ListArray.from_arrays(ends, pa.array(parities(key, first, words)))
                columns = [part.column("doc_id"), part.column("content"), *map(pa.array, (sid, chk, np.diff(first)))]
                yield pa.RecordBatch.from_arrays([*columns, odd], ["doc_id", "content", "sid", "chk", "n", "odd"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("content"))
    return docs.mapInArrow(tidy(name), f"doc_id {kind}, content long, sid long, chk long, n long, odd array<long>")


def segment_index(docs: DataFrame, size: int, bands: Bands, plans: dict[int, tuple[int, int, int]]) -> DataFrame:
    """sig, sid: what each set is indexed and searched by, under its own band and, if near, the one below."""
    bounds = bands.bounds(max([hi for hi in plans], default=0))
    highs = np.array([high for _, high in bounds], np.int64)
    allocated = np.array([plans[high] for _, high in bounds], np.int64).reshape(-1, 3)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                key, first = _sets(part, size)
                sid, chk = _names(key, first)
                number = np.diff(first)
                new = number > 0
                for i, name in enumerate(zip(sid.tolist(), chk.tolist())):
                    if name in seen:
                        new[i] = False
                    seen.add(name)
                band = np.searchsorted(highs, number)
                lower = new & (band > 0)
                lower[lower] = number[lower] * bands.num <= highs[band[lower] - 1] * bands.den
                for which, level in ((new, band), (lower, band - 1)):
                    text = np.flatnonzero(which)
                    if not len(text):
                        continue
                    keys = np.concatenate([key[first[i] : first[i + 1]] for i in text])
                    owner = np.repeat(np.arange(len(text)), number[text])
                    sig, at = signatures(keys, owner, len(text), allocated[level[text]], level[text])
                    yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(sid[text][at])], ["sig", "sid"])

    return docs.mapInArrow(tidy(index), "sig long, sid long")


def set_rows(docs: DataFrame, size: int) -> DataFrame:
    """sid, chk and the shingle hashes of each row's set."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                key, first = _sets(part, size)
                sid, chk = _names(key, first)
                keys = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(chk), keys], ["sid", "chk", "keys"])

    return docs.mapInArrow(tidy(rows), "sid long, chk long, keys array<long>")


def linked_components(
    docs: DataFrame, size: int, num: int, den: int, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_shingles, component_id and content (a hash of the text) of every row.

    Sets link at a similarity of ``num / den`` or more.
    """
    spark = docs.sparkSession
    prepare(spark)
    read = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    bands = Bands(num, den)
    named = stored(text_sets(read, size, bands), "sets").withColumn("node", _node())
    reps = named.where("n > 0").groupBy("node").agg(
        F.first("sid").alias("sid"), F.first("n").alias("n"), F.min("doc_id").alias("rep"), F.first("odd").alias("odd")
    )
    reps = stored(reps, "nodes")

    largest = reps.agg(F.max("n")).first()[0] or 0
    bounds = bands.bounds(largest)
    band = F.array_position(F.transform(_literal([hi for _, hi in bounds]), lambda hi: F.col("n") <= hi), True)
    stats = {row["band"]: row for row in reps.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("sets"), F.avg("n").alias("size")).collect()}
    plans = {}
    for i, (low, high) in enumerate(bounds):
        known = stats.get(i + 1)
        plans[high] = bands.allocate(known["size"] if known else low, high, known["sets"] if known else 1)

    same = Window.partitionBy("sig")
    index = segment_index(read, size, bands, plans)
    shared = index.withColumns(
        {"meets": F.count(F.lit(1)).over(same), "lo": F.min("sid").over(same), "hi": F.max("sid").over(same)}
    )
    shared = stored(shared.where("lo < hi"), "meetings")
    named_nodes = reps.select("sid", "node", "n")
    # most segments that meet at all join two sets: pairs already. The rest are groups
    two = shared.where("meets = 2 AND sid = lo").select("lo", "hi").distinct()
    two = two.join(named_nodes.toDF("lo", "x", "n"), "lo").join(named_nodes.toDF("hi", "y", "hub_n"), "hi")
    two = two.where(F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num)
    two = stored(
        two.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "n", "hub_n"), "met-once"
    )
    groups = shared.where("meets > 2").select("sig", "sid").distinct().join(named_nodes, "sid")
    groups = stored(groups.select("sig", "node", "n"), "groups")
    order = Window.partitionBy("sig").orderBy(F.desc("degree"), "node")
    degree = groups.groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    ranked = groups.join(degree, "node").withColumn("rank", F.row_number().over(order))
    ranked = stored(ranked.select("sig", "node", "n", "rank"), "ranked")

    nodes = degree.select("node").unionByName(two.select(F.explode(F.array("x", "y")).alias("node"))).distinct()
    labels = stored(nodes.select("node", F.col("node").alias("comp")), "labels")

    def sets_of(nodes: DataFrame) -> DataFrame:
        return stored(candidate_sets(read, nodes, reps, size), "candidate-sets")

    labels = _connect(ranked, two, sets_of, reps.select("node", "odd"), labels, num, den)

    least = labels.join(reps.select("node", "rep"), "node")
    comp = least.groupBy("comp").agg(F.min("rep").alias("component"))
    member = least.join(comp, "comp").select("node", "component")
    every = reps.select("node", "rep").join(member, "node", "left")
    every = every.select("node", F.coalesce("component", "rep").alias("component"))
    out = named.join(every, "node", "left")
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), "content")


def one_of_each(docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The documents, all columns, with one of each component: the one with its id. Of repeated rows one stays."""
    found = stored(linked_components(docs, size, num, den), "components")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id"))
    gone = _bounded(found.where(~stays).select(F.col("doc_id").alias("__id"), F.col("content").alias("__c")).distinct())
    many = found.where(stays).groupBy(F.col("doc_id").alias("__id"), F.col("content").alias("__c")).count()
    many = _bounded(many.where("count > 1").select("__id", "__c"))

    def same(other: DataFrame):
        return docs["doc_id"].eqNullSafe(other["__id"]) & (F.xxhash64(docs["text"]) == other["__c"])

    left = docs.join(gone, same(gone), "left_anti")
    once = left.join(many, same(many), "left_anti")
    repeated = left.join(many, same(many), "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)


def _bounded(ids: DataFrame) -> DataFrame:
    """The ids, to be broadcast only if they are few."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def _node():
    return F.concat(F.to_binary(F.lpad(F.hex("sid"), 16, "0"), F.lit("hex")),
                    F.to_binary(F.lpad(F.hex("chk"), 16, "0"), F.lit("hex")))


def _literal(numbers: list[int]):
    return F.array(*[F.lit(number).cast("long") for number in numbers]).cast("array<long>")


def candidate_sets(read: DataFrame, nodes: DataFrame, reps: DataFrame, size: int) -> DataFrame:
    """node, keys of some nodes."""
    wanted = nodes.select("node").distinct().join(reps.select("node", "rep"), "node")
    ids = _bounded(wanted.select(F.col("rep").alias("wanted_id")).distinct())
    texts = read.join(ids, read["doc_id"].eqNullSafe(ids["wanted_id"]), "left_semi")
    found = set_rows(texts, size).select(_node().alias("node"), "keys")
    return found.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _connect(
    ranked: DataFrame, two: DataFrame, sets_of: Callable[[DataFrame], DataFrame], parity: DataFrame,
    labels: DataFrame, num: int, den: int,
) -> DataFrame:
    """The labels (node, comp) after all pairs that meet, and can be similar, were compared or are connected.

    ranked: members of groups; two: pairs that meet where nobody else does.
    """
    unknown = F.lit(None).cast("long")
    members = ranked.select("*", F.lit(0).cast("long").alias("alone"), unknown.alias("more"), unknown.alias("fewer"))
    done = None
    low, high = 1, 1
    while True:
        here = members.join(labels, "node")
        across = Window.partitionBy("sig")
        live = here.withColumn("apart", F.min("comp").over(across) != F.max("comp").over(across))
        live = live.withColumn("last", F.max("rank").over(across)).where(F.col("apart") & (F.col("last") > low))
        live = stored(live.drop("apart"), "live")
        if low > 1 and live.isEmpty():
            return labels
        if low == 2:
            large = live.where(F.col("last") > LARGE_GROUP)
            bounded = _bounds(large, sets_of(large)).where(F.col("alone") * num <= F.col("n") * (den - num))
            live = live.where(F.col("last") <= LARGE_GROUP).unionByName(bounded)
            live = stored(live, "bounded")
            members = live.drop("comp", "last")
        pairs = _pairs(live.drop("last"), low, high, num, den)
        if done is None:
            pairs = pairs.unionByName(two).dropDuplicates(["x", "y"])
        else:
            pairs = pairs.join(done, ["x", "y"], "left_anti")
        # most pairs that met by chance go by their parities, before any set is fetched
        sized = pairs.join(parity.toDF("x", "odd_x"), "x").join(parity.toDF("y", "odd_y"), "y")
        allowed = (F.col("n") + F.col("hub_n")) * (den - num)
        near = sized.where(differ_at_least(F.col("odd_x"), F.col("odd_y")) * (den + num) <= allowed)
        pairs = stored(near.select("x", "y"), "pairs")
        done = pairs if done is None else stored(done.unionByName(pairs), "compared")
        if not pairs.isEmpty():
            sets = sets_of(pairs.select(F.explode(F.array("x", "y")).alias("node")))
            both = pairs.join(sets.toDF("x", "keys_x"), "x").join(sets.toDF("y", "keys_y"), "y")
            common = F.size(F.array_intersect("keys_x", "keys_y"))
            either = F.size("keys_x") + F.size("keys_y")
            links = both.where(common * (den + num) >= either * num).select("x", "y")
            edges = links.join(labels.toDF("x", "a"), "x").join(labels.toDF("y", "b"), "y").where("a <> b")
            labels = contract(labels, edges.select("a", "b"))
        low, high = high + 1, high * 4 + 3


def _pairs(live: DataFrame, low: int, high: int, num: int, den: int) -> DataFrame:
    """x, y and both sizes: the hubs of these ranks with all later members of their groups that lie apart and can be similar.

    Two sets differ at least by the shingles that no other has, and, where both were compared with the group's
    first hub, by what one has more or less over the hub than the other.
    """
    hubs = live.select("sig", *[F.col(name).alias(f"hub_{name}") for name in live.columns if name != "sig"])
    hubs = hubs.where(F.col("hub_rank").between(low, high))
    small, large = F.least("n", "hub_n"), F.greatest("n", "hub_n")
    over = F.abs((F.col("more") - F.col("alone")) - (F.col("hub_more") - F.col("hub_alone")))
    under = F.abs(F.col("fewer") - F.col("hub_fewer"))
    least = F.col("alone") + F.col("hub_alone") + F.coalesce(over + under, F.lit(0))
    pairs = live.join(hubs, "sig").where(
        (F.col("rank") > F.col("hub_rank"))
        & (F.col("comp") != F.col("hub_comp"))
        & (small * den >= large * num)
        & (least * (den + num) <= (F.col("n") + F.col("hub_n")) * (den - num))
    )
    return pairs.groupBy(F.least("node", "hub_node").alias("x"), F.greatest("node", "hub_node").alias("y")).agg(
        F.first("n").alias("n"), F.first("hub_n").alias("hub_n")
    )


def _bounds(live: DataFrame, sets: DataFrame) -> DataFrame:
    """The members of large groups with ``alone``, the shingles that no other member of any has, and ``more`` and
    ``fewer``, the sizes of the differences to and from the group's first hub, if that is a member still."""
    each = sets.select("node", F.explode("keys").alias("key"))
    single = each.groupBy("key").agg(F.count(F.lit(1)).alias("sets"), F.first("node").alias("node")).where("sets = 1")
    alone = single.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    hubs = live.where("rank = 1").select("sig", F.col("node").alias("hub"))
    met = stored(live.join(hubs, "sig").select("node", "hub").distinct(), "hub-members")
    both = met.join(sets.toDF("node", "mine"), "node").join(sets.toDF("hub", "its"), "hub")
    common = F.size(F.array_intersect("mine", "its")).cast("long")
    known = stored(
        both.select("node", "hub", (F.size("mine") - common).alias("more"), (F.size("its") - common).alias("fewer")),
        "hub-differences",
    )
    out = live.drop("alone", "more", "fewer").join(alone, "node", "left").join(hubs, "sig", "left")
    out = out.join(known, ["node", "hub"], "left")
    return out.withColumn("alone", F.coalesce("alone", F.lit(0).cast("long"))).select(*live.columns)
