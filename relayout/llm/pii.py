"""Personal data: patterns propose spans, checksums confirm them, context words nearby adjust their score.

Each kind has a pattern, a validator of the matched text, a score for having passed both, and words that raise the
score where they stand nearby (in the 32 characters before and 16 after, as far as the next match of the pattern).
Card numbers must pass Luhn's sum, account numbers (IBAN) the remainder by 97. A span is reported from a score of
KEPT on: addresses, checked card numbers of full length, phone numbers and checked account numbers reach it by
themselves, shorter card numbers and social security numbers only beside a word that names them.

Everything is one projection of DataFrame functions over each row: no shuffle, no join, no user function. Patterns take
possessive runs that start where a run starts (or the match before ended), so a text of one endless word costs time in
proportion to its length; positions are summed in blocks, so does a text of very many matches.

Defined cases. Null and empty text: no spans. Very long texts: whole, see above. Ties: spans of one start are told apart
by their kind, those of one kind never overlap. Repeated rows and rows of one or a null id: each row has its own result.
No rows: no rows. Columns besides id and text are ignored. Positions are code points, the end exclusive.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayout.llm.native_spans import with_spans

#: Least score, in hundredths, of a span that is reported.
KEPT = 50
#: Added for a context word.
NEARBY = 30

# Patterns of the base kinds, with the start of a run spelled out and runs possessive, which finds the
# same matches; 0 to 255 with leading zeros.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_DIGITS = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?"
_HYPHENATED = r"(?:\G|(?<![0-9-]))[0-9][0-9-]*+"
BYTE = "0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
FOUR_BYTES = rf"^{BYTE}(\.{BYTE}){{3}}$"
SOCIAL = "^(00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(0[1-9]|[1-9][0-9])-([0-9]{3}[1-9]|[0-9]{2}[1-9]0|[0-9][1-9]00|[1-9]000)$"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def remainder_97(value: Column) -> Column:
    """An account number, its first four signs moved to the end and letters as 10 to 35, modulo 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(total: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        letter = (total * 100 + code - 55) % 97
        return F.when(code >= 65, letter).otherwise((total * 10 + code - 48) % 97)

    return F.aggregate(F.regexp_extract_all(moved, F.lit("."), F.lit(0)), F.lit(0), step)


def _card(least: int, most: int) -> Callable[[Column], Column]:
    return lambda value: F.length(digits(value)).between(least, most) & F.call_function("luhn_check", digits(value))


@dataclass(frozen=True)
class Kind:
    """``guard``: a pattern every text with such a span matches; ``words``: context, alternatives of a pattern."""

    name: str
    pattern: str
    guard: str
    valid: Callable[[Column], Column]
    score: int
    words: str
    base: bool = False


KINDS = (
    Kind("email", _EMAIL, "@", lambda v: F.lit(True), 60, "e-?mail|mail|contact|correo|courriel|adresse", True),
    Kind("ip", _IP, r"\.[0-9]++\.[0-9]++\.[0-9]", lambda v: v.rlike(FOUR_BYTES), 50, "ip|host|server|login|client", True),
    Kind("card", _DIGITS, r"[0-9](?:[\x20-]?[0-9]){15}", _card(16, 19), 70, "card|visa|mastercard|carte|karte|tarjeta", True),
    Kind("phone", _PHONE, r"\+[0-9]", lambda v: F.length(digits(v)).between(8, 15), 50,
         "phone|tel|call|mobile|fax|telefon|telefono", True),
    Kind("iban", _IBAN, r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}",
         lambda v: F.length(F.replace(v, F.lit(" "), F.lit(""))).between(15, 34) & (remainder_97(v) == 1), 60,
         "iban|account|konto|compte|cuenta"),
    Kind("short_card", _DIGITS, r"[0-9](?:[\x20-]?[0-9]){12}", _card(13, 15), 30, "card|amex|diners|carte|karte|tarjeta"),
    Kind("ssn", _HYPHENATED, r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda v: v.rlike(SOCIAL), 30, "ssn|social|security"),
)


def context(words: str) -> str:
    return f"(?i)(^|[^A-Za-z])({words})([^A-Za-z]|$)"


def find_personal_data(docs: DataFrame, id_column: str = "doc_id", text: str = "text", kept: int = KEPT) -> DataFrame:
    """doc_id and ``spans``: kind (its number), start, end, value and score, by kind, then start."""
    whole = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(id_column).alias("doc_id"), whole.alias("text"))
    patterns = {kind.pattern: f"p{i}" for i, kind in enumerate(KINDS)}
    guards = {p: "|".join(kind.guard for kind in KINDS if kind.pattern == p) for p in patterns}
    found = with_spans(read, "text", {name: (p, guards[p]) for p, name in patterns.items()})

    def scored(number: int, kind: Kind) -> Column:
        def one(span: Column) -> Column:
            near = F.concat_ws(" ", span["before"], span["after"]).rlike(context(kind.words))
            score = F.least(F.lit(100), F.lit(kind.score) + F.when(near, NEARBY).otherwise(0))
            return F.struct(
                F.lit(number).alias("kind"), span["start"].alias("start"), span["end"].alias("end"),
                span["value"].alias("value"), score.alias("score"),
            )

        valid = F.filter(F.col(patterns[kind.pattern]), lambda span: kind.valid(span["value"]))
        return F.filter(F.transform(valid, one), lambda span: (span["score"] >= kept) | F.lit(kind.base))

    return found.select("doc_id", F.concat(*[scored(i, kind) for i, kind in enumerate(KINDS)]).alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end in the order of the spans, comma-joined."""
    names = F.array(*[F.lit(kind.name) for kind in KINDS])
    text = F.transform(
        spans,
        lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.concat_ws(",", text)


def summary(found: DataFrame) -> DataFrame:
    """Counts, digests and scores per row of ``find_personal_data``."""
    base = [i for i, kind in enumerate(KINDS) if kind.base]

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")

    own = F.filter("spans", lambda s: s["kind"].isin(base))
    return found.select(
        "doc_id", *[count(i).alias(f"n_{KINDS[i].name}") for i in base],
        F.sha2(digest(own), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"),
        F.concat_ws(",", F.transform("spans", lambda s: s["score"].cast("string"))).alias("scores"),
    )
