import math
import random

from relayout.llm import decontamination


def test_short_items_are_never_missed(spark, frame):
    seed = random.Random(4)
    items = {1: "one two three four five", 2: "six seven eight nine ten eleven", 3: "a b c d", 4: " ".join("klmnopqrstuvwxyz")}
    texts, want = [], set()
    for i in range(3000):
        body = [f"w{seed.randrange(10**9)}" for _ in range(60)]
        at = seed.randrange(60)
        texts.append((i, " ".join(body[:at] + [items[1 + i % 4]] + body[at:])))
        if i % 4 != 2:  # a whole text of four words is not a passage
            want.add((i, 1 + i % 4))
    texts += [(5000, "A b  C d"), (5001, "six seven eight nine ten"), (None, items[1]), (None, items[2])]
    want |= {(5000, 3), (None, 1), (None, 2)}
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    found = decontamination.contained_items(frame(texts), bench).collect()
    assert len(found) == len(want) and {(row.doc_id, row.item_id) for row in found} == want


def test_only_items_of_enough_shingles_are_sketched():
    least = decontamination.least_shared()
    for q in range(1, 200):
        shared = max(1, math.ceil(0.8 * q))
        load = decontamination.tuned_load(q)
        missed = (1 - (1 - math.exp(-load)) / load) ** shared
        assert (missed <= decontamination.MISS) == (shared >= least)
