"""Conversation repair: cheapest edits that make a conversation's roles alternate, by a suffix-shared word graph.

A conversation is a word of signs, one per row: its role's initial and its fault. Read from the end, words share their
common suffixes: a node of the graph is a suffix, whatever conversation it ends. For each node and each state of the
grammar ``(s?(ua)+)?`` the cost to go and the first letter of the best audit are computed once, from the node one sign
shorter; the best audit of a word is read off by following letters down its nodes. Edits are Keep (0), Rerole (2),
Delete (3, needed for blank and repeated rows) and Insert (2); a truncated row that stays adds 1. Among equal costs the
letter that is least in ASCII is taken at each node, which gives the least audit, since letters differ by edit.

How it runs. Faults are found by grouping digests of rows, not texts. Rows' signs are put in order by range
partitions of (conversation, turn), so a conversation with a third of all rows is spread over tasks and comes back as
a string of one sign a row. Words are sorted by their reverse, across tasks too; equal suffixes are neighbours then, and
a task holds one path of the graph, the nodes of the word it is at. A common word shares its nodes but is split over
tasks by conversation. At last the texts are read in order beside their audits and hashed as they pass. A digest
of one conversation is a chain from its first byte to its last, so one task passes over a conversation's texts; it holds
one batch of them.

Defined cases. Null role and text: one space. Null turns come first. Ties: rows of one turn are taken by role, then by a
digest of role and text; repeated rows are neighbours. Null conv_id: a conversation like others. Empty and very long
texts: blank, and whole. A conversation without rows left: zeros, empty audit, hash of nothing. No rows: no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayout.llm.shared import prepare, stored

# White space, the ends of a sentence, costs of edits, and the grammar: the role that each state takes
# next, and the state after it (0 start, 1 after system, 2 after user, 3 after assistant).
BLANKS = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NEEDS, AFTER, ROLES = "uuau", (2, 2, 3, 2), {"u": "user", "a": "assistant"}
END = ((0, 4, 2, 0), ".II.")

#: One sign per row: role (s, u, a, other) by fault (none, truncated, blank, repeated).
ROLE_SIGNS = "suao"
SIGNS = {"": "suao", "truncated": "SUAO", "blank": "1234", "duplicate": "5678"}
#: Signs of one fragment of a word; longer words come in several.
FRAGMENT = 1 << 20
#: Signs from the end by which words are dealt to tasks; the sort within a task is by all.
DEALT_BY = 64
#: Fragments that leave a task at a time.
BATCH_LINES = 4096


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``copies``: rows dropped (0), emptied, cut, repeated (2) or given to the user."""
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), F.lit(" ")),
    )
    rows = conversations.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text"), F.lit(" ")).alias("text"), (F.crc32(key) % 20).alias("harm"),
    )
    cut = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]+", ""))
    copies = F.when(F.col("harm") == 0, 0).when(F.col("harm") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"),
        cut.otherwise(F.col("text")).alias("text"), copies.cast("long").alias("copies"),
    )


def _digest() -> Column:
    return F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _by(*names: str) -> list[Column]:
    return [F.col(name).asc_nulls_first() for name in names]


def words(rows: DataFrame) -> DataFrame:
    """conv_id, word and gaps of each conversation of ``damage``'s columns."""
    last = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    initial = F.left("role", F.lit(1))
    facts = rows.select(
        "conv_id", "turn", "role", _digest().alias("digest"), "copies",
        F.when(initial.isin(*ROLE_SIGNS[:3]), F.instr(F.lit(ROLE_SIGNS), initial)).otherwise(4).alias("sign"),
        (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
    )
    lines = facts.groupBy(*[name for name in facts.columns if name != "copies"]).agg(F.sum("copies").alias("copies"))
    lines = stored(lines, "conversation-lines")
    first = (
        lines.where("copies > 0")
        .groupBy(F.col("conv_id").alias("__conv"), F.col("digest").alias("__digest"))
        .agg(F.min(F.struct("turn")).alias("__first"))
    )
    same = F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("digest") == F.col("__digest"))
    known = lines.join(first, same, "left")
    earlier = ~F.struct("turn").eqNullSafe(F.col("__first"))

    def sign(fault: str) -> Column:
        return F.substring(F.lit(SIGNS[fault]), F.col("sign"), F.lit(1))

    # a row's copies are neighbours: the first may be new, the others never are
    plain = F.when(F.col("truncated"), sign("truncated")).otherwise(sign(""))
    signs = (
        F.when(F.col("copies") == 0, "")
        .when(F.col("blank"), F.repeat(sign("blank"), F.col("copies").cast("int")))
        .when(earlier, F.repeat(sign("duplicate"), F.col("copies").cast("int")))
        .otherwise(F.concat(plain, F.repeat(sign("duplicate"), F.col("copies").cast("int") - 1)))
    )
    dealt = stored(known.select("conv_id", "turn", "role", "digest", signs.alias("signs")), "conversation-signs")
    kinds = {name: dealt.schema[name].dataType.simpleString() for name in ("conv_id", "turn")}
    schema = f"conv_id {kinds['conv_id']}, part long, word string, low {kinds['turn']}, high {kinds['turn']}, n long"
    order = _by("conv_id", "turn", "role", "digest")
    fragments = dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_fragments, schema)
    found = fragments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "word", "low", "high", "n"))).alias("f"))
    # the turn at a fragment's end may go on in the next one
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast(kinds["turn"]).alias("last"))
    turns = F.aggregate(
        "f", none,
        lambda state, f: F.struct(
            (state["n"] + f["n"] - F.when(f["low"] == state["last"], 1).otherwise(0)).alias("n"),
            F.coalesce(f["high"], state["last"]).alias("last"),
        ),
        lambda state: state["n"],
    )
    low, high = F.array_min(F.transform("f", lambda f: f["low"])), F.array_max(F.transform("f", lambda f: f["high"]))
    return found.select(
        "conv_id", F.array_join(F.transform("f", lambda f: f["word"]), "").alias("word"),
        F.coalesce((high - low + 1 - turns).cast("long"), F.lit(0)).cast("long").alias("gaps"),
    )


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signs of rows in order, joined to words; a word that goes on in the next task is two fragments."""
    number = TaskContext.get().partitionId() << 32
    types = None
    done: list[tuple] = []
    now, word, size, low, high, n = None, [], 0, None, None, 0
    begun = False

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        names = ["conv_id", "part", "word", "low", "high", "n"]
        kinds = [types["conv_id"], pa.int64(), pa.string(), types["turn"], types["turn"], pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        types = types or {name: batch.schema.field(name).type for name in ("conv_id", "turn")}
        columns = [batch.column(name).to_pylist() for name in ("conv_id", "turn", "signs")]
        for conv, turn, signs in zip(*columns):
            if not begun or conv != now or size >= FRAGMENT:
                if begun:
                    done.append((now, number + len(done), "".join(word), low, high, n))
                begun, now, word, size, low, high, n = True, conv, [], 0, None, None, 0
            if signs:  # a dropped row has none
                word.append(signs)
                size += len(signs)
                if turn is not None and turn != high:
                    low, high, n = turn if low is None else low, turn, n + 1
        if len(done) >= BATCH_LINES:
            yield batch_of(done)
            number, done = number + len(done), []
    if begun:
        done.append((now, number + len(done), "".join(word), low, high, n))
    if done:
        yield batch_of(done)


_known: dict[tuple, tuple] = {}


def node(sign: str, costs: tuple) -> tuple[tuple, str]:
    """Costs to go by state, and the first letter of each state's best audit, of a suffix that begins with ``sign``.

    ``costs`` are those of the suffix one sign shorter. Costs only matter by their differences, so few cases ever occur.
    """
    base = min(costs)
    found = _known.get(key := (sign, tuple(cost - base for cost in costs)))
    if found is None:
        found = _known[key] = _node(*key)
    return tuple(cost + base for cost in found[0]), found[1]


def _node(sign: str, costs: tuple) -> tuple[tuple, str]:
    role, extra = sign.lower(), TRUNCATED * sign.isupper()
    ways = []
    for state in range(4):
        way = {"D": DELETE + costs[state]}
        if sign != "x":
            way["R"] = REROLE + extra + costs[AFTER[state]]
            if role == NEEDS[state]:
                way["K"] = extra + costs[AFTER[state]]
            elif role == "s" and state == 0:
                way["K"] = extra + costs[1]
        ways.append(way)
    least = [min(way.values()) for way in ways]
    for state in (2, 3):  # an insertion goes on in another state before the same row; three never pay
        ways[state]["I"] = INSERT + least[AFTER[state]]
    for state in (0, 1):
        ways[state]["I"] = INSERT + min(ways[2].values())
    totals = tuple(min(way.values()) for way in ways)
    return totals, "".join(min(letter for letter in way if way[letter] == total) for way, total in zip(ways, totals))


def step(letter: str, state: int, sign: str) -> int:
    """The state after an edit."""
    if letter == "D":
        return state
    return 1 if letter == "K" and state == 0 and sign in "sS" else AFTER[state]


class Path:
    """The nodes of one word, from its end; words that come sorted by their reverse share what they can."""

    def __init__(self) -> None:
        self.word, self.nodes, self.audit = "", [END], ""

    def go(self, word: str) -> tuple[int, str]:
        """Cost and audit of a reversed word."""
        shared = len(commonprefix([word, self.word]))
        if shared < len(word) or shared < len(self.word):
            del self.nodes[shared + 1 :]
            for sign in word[shared:]:
                self.nodes.append(node(sign, self.nodes[-1][0]))
            self.word = word
            self.audit = self._best()
        return self.nodes[-1][0][0], self.audit

    def _best(self) -> str:
        letters, state, at = [], 0, len(self.word)
        while True:
            letter = self.nodes[at][1][state]
            if letter == ".":
                return "".join(letters)
            letters.append(letter)
            state = step(letter, state, self.word[at - 1] if at else "")
            at -= letter != "I"


_TO_ROLE = str.maketrans("".join(SIGNS.values()), ROLE_SIGNS * 4)
_FOR_GRAPH = str.maketrans(SIGNS["blank"] + SIGNS["duplicate"], "x" * 8)


def plans(found: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit, from ``words``."""
    forced = SIGNS["blank"] + SIGNS["duplicate"]
    found = stored(found, "conversation-words")
    reverse = F.reverse(F.translate("word", forced, "x" * len(forced)))
    sorted_by = found.withColumns({"__end": F.left(reverse, F.lit(DEALT_BY)), "__reverse": reverse})
    dealt = sorted_by.repartitionByRange("__end", "conv_id").sortWithinPartitions("__reverse", "conv_id")
    kind = found.schema["conv_id"].dataType.simpleString()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = Path()
        for batch in batches:
            rows = []
            for word, gaps in zip(*(batch.column(name).to_pylist() for name in ("word", "gaps"))):
                cost, audit = path.go(word.translate(_FOR_GRAPH)[::-1])
                roles = word.translate(_TO_ROLE)
                legal = sum(map(roles.count, ("su", "ua", "au")))
                by_fault = [sum(map(word.count, SIGNS[fault])) for fault in ("blank", "duplicate", "truncated")]
                rows.append((gaps, *by_fault, max(len(word) - 1, 0) - legal, cost, audit))
            if rows:
                kinds = [pa.int64()] * len(counts) + [pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *columns], ["conv_id", *counts, "audit"])

    schema = f"conv_id {kind}, {', '.join(f'{name} long' for name in counts)}, audit string"
    return dealt.select("conv_id", "word", "gaps").mapInArrow(solve, schema)


def _beside(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """Each conversation's plan, then its rows in order, in one task."""
    rows = rows.where("copies > 0").select(
        "conv_id", F.lit(1).alias("level"), "turn", "role", _digest().alias("digest"), "text", "copies",
        *[F.lit(None).cast(kind).alias(name) for name, kind in planned.dtypes if name != "conv_id"],
    )
    ahead = planned.withColumns(
        {name: F.lit(None).cast(kind) for name, kind in rows.dtypes if name not in planned.columns}
    ).withColumn("level", F.lit(0))
    both = ahead.select(*rows.columns).unionByName(rows)
    return both.repartition("conv_id").sortWithinPartitions(*_by("conv_id", "level", "turn", "role", "digest"))


class Replay:
    """A conversation's audit carried out row by row: lines of role and text that stay or are put in."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            yield ROLES[NEEDS[self.state]], ""
            self.state, self.at = AFTER[self.state], self.at + 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter != "D":
            yield (role if letter == "K" else ROLES[NEEDS[self.state]]), text
            self.state = step(letter, self.state, role[:1])


def _replayed(batches: Iterator[pa.RecordBatch], line: Callable, end: Callable) -> Iterator[None]:
    """Call ``line`` for every line and ``end`` after each conversation; yields after each batch."""
    replay, plan = None, None
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names if name != "digest"}
        for i, level in enumerate(columns["level"]):
            if level == 0:
                if replay is not None:
                    for one in replay.inserted():
                        line(plan, *one)
                    end(plan)
                plan = {name: values[i] for name, values in columns.items()}
                replay = Replay(plan["audit"])
                continue
            for _ in range(columns["copies"][i]):
                for one in replay.row(columns["role"][i], columns["text"][i]):
                    line(plan, *one)
        yield
    if replay is not None:
        for one in replay.inserted():
            line(plan, *one)
        end(plan)
    yield


def repair(rows: DataFrame) -> DataFrame:
    """The plan of each conversation and ``repaired_sha256``, the digest of its repaired lines."""
    prepare(rows.sparkSession)
    planned = stored(plans(words(rows)), "conversation-plans")
    names = [*planned.columns, "repaired_sha256"]
    schema = ", ".join(f"{name} {kind}" for name, kind in planned.dtypes) + ", repaired_sha256 string"

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        state: dict = {"sha": hashlib.sha256(), "first": True}

        def line(plan: dict, role: str, text: str) -> None:
            head = "" if state["first"] else "\n"
            state["first"] = False
            state["sha"].update(f"{head}{role}:{text}".encode())

        def end(plan: dict) -> None:
            out.append((*(plan[name] for name in planned_names), state["sha"].hexdigest()))
            state.update(sha=hashlib.sha256(), first=True)

        for _ in _replayed(batches, line, end):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out.clear()

    planned_names = planned.columns
    kinds = [*_arrow_types(planned), pa.string()]
    return _beside(rows, planned).mapInArrow(digests, schema)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """conv_id, position, role and text of every repaired conversation."""
    prepare(rows.sparkSession)
    planned = stored(plans(words(rows)), "conversation-plans")
    kinds = [_arrow_types(planned)[0], pa.int64(), pa.string(), pa.string()]
    schema = f"conv_id {planned.schema['conv_id'].dataType.simpleString()}, position long, role string, text string"

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        at = [0]

        def line(plan: dict, role: str, text: str) -> None:
            out.append((plan["conv_id"], at[0], role, text))
            at[0] += 1

        def end(plan: dict) -> None:
            at[0] = 0

        for _ in _replayed(batches, line, end):
            if out:
                names = ["conv_id", "position", "role", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out.clear()

    return _beside(rows, planned).mapInArrow(lines, schema)


def _arrow_types(df: DataFrame) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(field.dataType) for field in df.schema.fields]
