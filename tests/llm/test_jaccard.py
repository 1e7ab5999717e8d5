import random
import re

import pytest

from relayout.llm import jaccard, queries

from .conftest import SF, collected

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size, num, den):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a]) + len(sets[b]) - common):
                    parent[find(a)] = find(b)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i) if sets[i] else ("empty", i), []).append(doc_id)
    least = {k: min((x for x in v if x is not None), default=None) for k, v in groups.items()}
    return [
        (doc_id, len(sets[i]), least[find(i) if sets[i] else ("empty", i)]) for i, (doc_id, _) in enumerate(rows)
    ]


def check(frame, rows, size, num, den):
    found = jaccard.linked_components(frame(rows), size, num, den).drop("content")
    assert sorted(collected(found), key=repr) == sorted(brute(rows, size, num, den), key=repr)


@pytest.mark.parametrize("size,num,den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_against_brute_force(frame, size, num, den):
    seed = random.Random(size)
    rows = []
    for group in range(12):
        base = [f"w{seed.randint(0, 300)}" for _ in range(seed.choice([1, 2, 4, 12, 30, 80, 200, 400]))]
        rows.append((len(rows), " ".join(base)))
        for _ in range(seed.randint(0, 14)):
            words = list(base)
            for _ in range(seed.randint(0, max(1, len(words) // 25))):
                at = seed.randrange(len(words))
                words[at : at + seed.randint(0, 2)] = [f"w{seed.randint(0, 300)}"] * seed.randint(0, 2)
            rows.append((len(rows), seed.choice([" ", "\n", "  "]).join(words or base).title()))
    seed.shuffle(rows)
    check(frame, rows, size, num, den)


def test_large_group_of_near_copies(frame):
    seed = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(250):
        words = list(base)
        for _ in range(seed.randint(0, 6)):
            words[seed.randrange(150)] = f"x{seed.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    check(frame, rows, 3, 90, 100)


def test_odd_rows(frame, odd_texts):
    made = [text if isinstance(text, tuple) else (i + 1, text) for i, text in enumerate(odd_texts)]
    check(frame, [(i, t) for i, t in made], 3, 90, 100)


def test_no_rows(frame):
    assert collected(jaccard.linked_components(frame([]), 3, 90, 100)) == []
    assert collected(jaccard.one_of_each(frame([]), 3, 90, 100)) == []


def test_given_table(spark, documents):
    found = collected(queries.QUERIES["op2_jaccard_join"](spark, SF))
    assert sorted(found) == sorted(brute([row[:2] for row in documents], 3, 90, 100))


def test_one_of_each(frame):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, text), (3, text + " end"), (7, "alone in the world"), (9, ""), (9, "")]
    kept = jaccard.one_of_each(frame(rows), 5, 80, 100)
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(3, text + " end"), (7, "alone in the world"), (9, "")]


@pytest.mark.parametrize("num,den", [(90, 100), (80, 100), (50, 100)])
def test_allocation_covers_every_difference(num, den):
    bands = jaccard.Bands(num, den)
    bounds = bands.bounds(3000)
    assert [low for low, _ in bounds[1:]] == [high + 1 for _, high in bounds[:-1]]
    for low, high in bounds:
        exact, near, skip = bands.allocate((low + high) / 2, high, 1000)
        assert exact >= skip and exact - skip + 2 * near >= bands.differ(high) + 1
    for a in range(1, 400):
        for b in range(a, a * den // num + 1):
            band = next(i for i, (low, high) in enumerate(bounds) if low <= a <= high)
            least = -(-num * (a + b) // (num + den))  # smallest intersection that links
            assert a + b - 2 * least <= bands.differ(bounds[band][1])
