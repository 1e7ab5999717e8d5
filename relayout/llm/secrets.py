"""Secret scans: spans of credential patterns, and whose they are, by corpus-wide ownership frequency.

Each text gives base spans (assignments, access keys, long hexadecimal runs) and further candidates (bare tokens that
mix letters and digits). A value is a candidate by its hash. Over the whole corpus the distinct repositories
and owners of each hash are counted, pre-aggregated by owner first: a value that many owners hold is a copied
example; one that few owners hold is a live-looking credential of theirs. Base spans always stay; a bare token
becomes a span only if it looks live. In the documents table each document is a repository and its source the
owner.

Only DataFrame functions run here. Positions come from the pieces between matches, in code points.

Defined cases. Null and empty text: no spans. Null owner: one more owner. Repeated rows: each gets its result and they
are one repository. Null ids: kept, one repository. No rows: no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayout.llm.shared import stored

#: A value held by at least so many owners is a copied example.
EXAMPLE_OWNERS = 3

# The patterns, with the group that holds the value and the length it needs.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
BARE = r"[A-Za-z0-9+/_=-]{20,}"
REDACTED = "[REDACTED]"
#: Documents with secrets to redact (some 100 bytes each) that may be broadcast.
BROADCAST_MARKS = 100_000


def matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Leftmost non-overlapping matches whose value is long enough: start, kind, end, value."""
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(between.alias("gap"), whole.alias("whole"), value.alias("value"))
    kindless = "array<struct<start:int,kind:int,end:int,value:string>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kindless).alias("found"))

    def step(state: Column, part: Column) -> Column:
        begin = state["at"] + F.length(part["gap"])
        end = begin + F.coalesce(F.length(part["whole"]), F.lit(0))
        span = F.struct(
            begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), part["value"].alias("value")
        )
        more = F.when(F.length(part["value"]) >= least, F.array(span)).otherwise(F.array().cast(kindless))
        return F.struct(end.alias("at"), F.concat(state["found"], more).alias("found"))

    found = F.aggregate(parts, start, step, lambda state: state["found"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(kindless))


def digest(spans: Column) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    names = F.array(*[F.lit(kind[0]) for kind in KINDS], F.lit("bare"))
    text = F.transform(
        F.sort_array(spans),
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.concat_ws(",", text)


def scan(docs: DataFrame, id_column: str = "doc_id", owner: str = "source", text: str = "text") -> DataFrame:
    """row, doc_id, owner, base and bare spans of every row; only spans leave the scan, not texts."""
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(
        F.col(id_column).alias("doc_id"), F.col(owner).cast("string").alias("owner"), whole.alias("text")
    )
    found = [matches(F.col("text"), pattern, group, least, k) for k, (_, pattern, group, least) in enumerate(KINDS)]
    mixed = F.filter(
        matches(F.col("text"), BARE, 0, 20, len(KINDS)),
        lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"),
    )
    spans = read.select(
        "doc_id", "owner", F.xxhash64("text").alias("content"), F.concat(*found).alias("base"), mixed.alias("wide")
    )
    apart = F.filter(
        "wide",
        lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return spans.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "content", "base", apart.alias("bare")
    )


def ownership(candidates: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """n_repositories, n_owners and copied for each value hash; candidates: hash, owner, repository."""
    held = candidates.select("hash", "owner", "repository").distinct()  # pre-aggregated before each shuffle
    by_owner = held.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    counted = by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories")
    )
    return counted.withColumn("copied", F.col("n_owners") >= example_owners)


def find_secrets(
    docs: DataFrame, id_column: str = "doc_id", owner: str = "source", text: str = "text",
    example_owners: int = EXAMPLE_OWNERS,
) -> DataFrame:
    """doc_id, content, base, bare (the live-looking ones), live_values and counts of live and copied spans."""
    spans = stored(scan(docs, id_column, owner, text), "secret-spans")
    found = spans.where((F.size("base") > 0) | (F.size("bare") > 0))
    each = found.select("row", "doc_id", "owner", F.explode(F.concat("base", "bare")).alias("span"))
    each = each.select("row", "doc_id", "owner", "span", F.xxhash64("span.value").alias("hash"))
    owned = ownership(each.select("hash", "owner", F.col("doc_id").alias("repository")), example_owners)
    judged = each.join(owned, "hash")
    bare = F.col("span.kind") == len(KINDS)
    per_row = judged.groupBy("row").agg(
        F.collect_list(F.when(bare & ~F.col("copied"), F.col("span"))).alias("bare_live"),
        F.collect_set(F.when(~F.col("copied"), F.col("span.value"))).alias("live_values"),
        F.count_if(~F.col("copied")).alias("n_live"),
        F.count_if(F.col("copied") & ~bare).alias("n_copied"),
    )
    none = F.array()
    kind = spans.schema["bare"].dataType
    quiet = spans.where((F.size("base") == 0) & (F.size("bare") == 0)).select(
        "doc_id", "content", "base", none.cast(kind).alias("bare"), none.cast("array<string>").alias("live_values"),
        F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_copied"),
    )
    loud = found.join(per_row, "row").select(
        "doc_id", "content", "base", F.col("bare_live").alias("bare"), "live_values", "n_live", "n_copied"
    )
    return quiet.unionByName(loud)


def redact(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """The documents, live-looking values replaced in the text, ``n_chars`` (if there) of the new text."""
    found = find_secrets(docs, example_owners=example_owners).where("n_live > 0")
    marks = found.groupBy(F.col("doc_id").alias("__id"), F.col("content").alias("__content")).agg(
        F.flatten(F.collect_list("live_values")).alias("__values")
    )
    marks = stored(marks, "secret-marks")
    if marks.limit(BROADCAST_MARKS + 1).count() <= BROADCAST_MARKS:
        marks = F.broadcast(marks)
    content = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    joined = docs.join(marks, docs["doc_id"].eqNullSafe(marks["__id"]) & (content == marks["__content"]), "left")
    longest = F.array_sort(
        F.array_distinct("__values"),
        lambda a, b: F.coalesce(
            F.nullif(F.length(b) - F.length(a), F.lit(0)),
            F.when(a < b, F.lit(-1)).when(a > b, F.lit(1)).otherwise(F.lit(0)),
        ),
    )
    cleaned = F.aggregate(longest, F.col("text"), lambda whole, value: F.replace(whole, value, F.lit(REDACTED)))
    text = F.when(F.col("__values").isNotNull(), cleaned).otherwise(F.col("text"))
    out = {"text": text}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("__values").isNotNull(), F.length(cleaned).cast("long")).otherwise(
            F.col("n_chars")
        )
    return joined.withColumns(out).select(*docs.columns)
