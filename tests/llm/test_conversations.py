"""Conversation repair against a plain search in Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from relayout.llm import conversations, queries
from relayout.llm.shared import stored

from .conftest import SF

SPACE = " \t\n\x0b\x0c\r"
NEEDS = {0: "u", 1: "u", 2: "a", 3: "u"}
AFTER = {0: 2, 1: 2, 2: 3, 3: 2}


def damaged(rows):
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        row = (conv, turn, "user" if harm == 4 else role, text)
        yield from [row] * (0 if harm == 0 else 2 if harm == 3 else 1)


def in_order(rows):
    def key(row):
        digest = hashlib.sha256(f"{len(row[2])}:{row[2]}{row[3]}".encode()).digest()
        return (row[1] is not None, row[1] or 0, row[2].encode(), digest)

    return sorted(rows, key=key)


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = text.rstrip(SPACE)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else ""
        out.append(fault or ("truncated" if solid[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, lines) by comparing whole audits, insertions tried up to three in a row."""
    best = {}
    for at in range(len(rows), -1, -1):
        def ways(state):
            if at == len(rows):
                return [(0, "", [])] if state in (0, 3) else []
            out = []
            role, text, fault = rows[at][2], rows[at][3], found[at]
            cost, audit, lines = best[at + 1, state]
            out.append((3 + cost, "D" + audit, lines))
            if fault in ("", "truncated"):
                more = int(fault == "truncated")
                named = "user" if NEEDS[state] == "u" else "assistant"
                cost, audit, lines = best[at + 1, AFTER[state]]
                out.append((2 + more + cost, "R" + audit, [f"{named}:{text}", *lines]))
                for state_after in [AFTER[state]] * (role[:1] == NEEDS[state]) + [1] * (role[:1] == "s" and state == 0):
                    cost, audit, lines = best[at + 1, state_after]
                    out.append((more + cost, "K" + audit, [f"{role}:{text}", *lines]))
            return out

        for state in range(4):
            options, now, head = [], state, []
            for inserts in range(4):
                options += [(2 * inserts + c, "I" * inserts + a, [*head, *lines]) for c, a, lines in ways(now)]
                head.append("user:" if NEEDS[now] == "u" else "assistant:")
                now = AFTER[now]
            best[at, state] = min(options)
    return best[0, 0]


def brute(rows):
    ids = {row[0] for row in rows}
    by = {conv: [] for conv in ids}
    for row in damaged(rows):
        by[row[0]].append(row)
    for conv, own in by.items():
        own = in_order(own)
        found = faults(own)
        turns = {turn for _, turn, *_ in own if turn is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        initials = [role[:1] for _, _, role, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, lines = cheapest(own, found)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        yield (conv, gaps, *map(found.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)


def test_audits_against_all_scripts():
    """Every edit script of short words, by the grammar as a pattern."""
    for word in itertools.chain.from_iterable(itertools.product("suaoUx", repeat=n) for n in range(4)):
        best = None
        for inserts in range(5):
            for spots in itertools.combinations_with_replacement(range(len(word) + 1), inserts):
                for edits in itertools.product("KRD", repeat=len(word)):
                    if any(sign == "x" and edit != "D" for sign, edit in zip(word, edits)):
                        continue
                    for chosen in itertools.product("ua", repeat=inserts + edits.count("R")):
                        new = iter(chosen)
                        audit, roles, cost = "", "", 2 * inserts
                        for at in range(len(word) + 1):
                            for _ in range(spots.count(at)):
                                audit, roles = audit + "I", roles + next(new)
                            if at < len(word):
                                edit = edits[at]
                                audit += edit
                                cost += {"K": 0, "R": 2, "D": 3}[edit] + (word[at] == "U" and edit != "D")
                                roles += {"K": word[at].lower(), "D": ""}.get(edit) if edit != "R" else next(new)
                        if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                            best = cost, audit
        assert conversations.Path().go("".join(word)[::-1]) == best, word


def test_shared_nodes_give_what_new_ones_give():
    seed = random.Random(4)
    words = sorted("".join(seed.choices("suaoSUAOx", k=seed.randint(0, 40))) for _ in range(2000))
    path = conversations.Path()
    for word in words + words[:50]:
        assert path.go(word) == conversations.Path().go(word)


def rows_of(out):
    return sorted((tuple(row) for row in out.collect()), key=repr)


def test_given_table(spark, duck):
    rows = duck.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    got = rows_of(queries.QUERIES["op13_conversation_repair"](spark, SF))
    assert got == sorted(brute(rows), key=repr) and {letter for row in got for letter in row[7]} >= {"D", "K"}


@pytest.mark.parametrize("fragment", [1 << 20, 3])
def test_odd_rows(spark, monkeypatch, fragment):
    monkeypatch.setattr(conversations, "FRAGMENT", fragment)
    seed = random.Random(6)
    roles = ["system", "user", "assistant", "tool", "", None, "User", "s", "a"]
    texts = ["Yes.", "no", "", " \n", None, "Why?!", "x" * 50_000 + ".", "é! ", "a\x00b", "end. \x0b\x0c", "Yes."]
    rows = []
    for conv in [None, *range(-3, 60)]:
        for _ in range(seed.randint(1, 9)):
            rows.append((conv, seed.choice([None, *range(7)]), seed.choice(roles), seed.choice(texts)))
    rows += [(500, turn, seed.choice(roles[:3]), seed.choice(texts)) for turn in range(700)]  # a long one
    rows += [(None, None, "user", "the same row")] * 40 + [(9, 3, "user", "Yes.")] * 3
    schema = "conv_id long, turn long, role string, text string, copies string, digest string, level int, word string"
    frame = spark.createDataFrame([(*row, "x", "x", 1, "x") for row in rows], schema).repartition(5)
    found = conversations.repair(conversations.damage(frame))
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert rows_of(found.select(names)) == sorted(brute(rows), key=repr)
    lines = stored(conversations.repaired_rows(conversations.damage(frame)), "lines").orderBy("conv_id", "position").collect()
    for conv, *_, sha in brute(rows):
        own = "\n".join(f"{r.role}:{r.text}" for r in lines if r.conv_id == conv)
        assert hashlib.sha256(own.encode()).hexdigest() == sha
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in lines if r.conv_id == conv))


def test_no_rows(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.repair(conversations.damage(none)).collect() == []
    assert conversations.repaired_rows(conversations.damage(none)).collect() == []
