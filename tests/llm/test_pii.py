"""Personal data against the plain patterns in Python, checksums by hand."""

import hashlib
import random
import re
import time

import pytest

from relayout.llm import native_spans, pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(number)))) % 10 == 0


def base(text):
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(number) <= 19 and luhn(number)):
                continue
            if kind == "phone" and not 8 <= len(number) <= 15:
                continue
            yield kind, m.start(), m.end()


def check(rows, texts):
    for row, text in zip(rows, texts):
        own = list(base(text))
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in own)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [row[f"n_{kind}"] for kind in PLAIN] == [sum(k == kind for k, *_ in own) for kind in PLAIN]
        assert [s for s in row.spans.split(",") if s.split(":")[0] in PLAIN] == (joined.split(",") if own else [])
        assert len(row.scores.split(",")) == len(row.spans.split(","))


def summaries(spark, texts, **extra):
    rows = [(i, text, "x", "y") for i, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, p0 string").coalesce(1)
    return sorted(pii.summary(pii.find_personal_data(docs, **extra)).collect(), key=lambda row: row.doc_id)


SAMPLES = [
    "a@b.c_x@d.e.f-@g.h", "me@@x.y me@x y@z..w", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "é1.1.1.1é",
    "4539 1488 0343 6467, 4539-1488-0343-6467-", "4539  1488 0343 6467", "45391488034364671234567890",
    "+1 (743) 555-3824 +12 +1.......... +49 30 123456+49 30 1234567 +1((((9", "+1234567 +12345678 +1234567890123456",
    "DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, GB82WEST12345698765433", "ssn 123-45-6789, 123-45-6789",
    "number 123-45-6789 only", "amex 378282246310005", "378282246310005 alone", "mail: x@y.zz", None, "", "\n",
]


def test_samples(spark):
    rows = summaries(spark, SAMPLES)
    check(rows, SAMPLES)
    assert rows[9].spans == "iban:0:27,iban:32:54"
    assert rows[10].spans == "ssn:4:15"  # the context of a match ends at the one before
    assert rows[11].spans == "" and rows[12].spans == "short_card:5:20" and rows[13].spans == ""
    assert rows[14].scores == "90" and rows[0].scores == "60,60,60"


def test_random_texts(spark):
    seed = random.Random(7)
    pieces = ["a", "@", ".", "b-", "1", "23", "255", "+", " ", "-", "(", ")", "é", "\U0001f600", "_", "%", "4539148803436467"]
    texts = ["".join(seed.choices(pieces, k=seed.randint(0, 60))) for _ in range(1500)]
    check(summaries(spark, texts), texts)


def test_positions_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(native_spans, "BLOCK", 3)
    texts = ["x@y.z " * n for n in range(12)]
    check(summaries(spark, texts), texts)


@pytest.mark.parametrize(
    "text",
    ["a" * 3_000_000, "1 " * 1_500_000, "a@" * 1_500_000, "1-" * 1_500_000, "x@y.zz 10.0.0.1 " * 40_000],
)
def test_very_long_texts(spark, text):
    started = time.monotonic()
    row = summaries(spark, [text])[0]
    assert time.monotonic() - started < 60
    if "zz" in text:
        assert row.n_email == row.n_ip == 40_000
    else:
        assert row.n_email == row.n_ip == row.n_card == 0


def test_no_rows(spark):
    assert summaries(spark, []) == []


def test_one_projection(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.find_personal_data(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Generate|Join", plan)
