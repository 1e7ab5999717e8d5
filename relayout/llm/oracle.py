"""The operators' questions in plain SQL, for those that SQL can express."""

from __future__ import annotations

from relayout.llm import decontamination, pii, quality, secrets

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

DECONTAMINATION = rf"""
WITH d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                                  '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
b AS (
    SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                                   '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
ds AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
bs AS (
    SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item
HAVING count(*) / n_item >= {decontamination.CONTAINMENT}
"""


def _quality() -> str:
    rules = []
    for rule in quality.RULES:
        if rule.least is not None:
            rules.append(f"{rule.measure} >= {rule.least}")
        if rule.most is not None:
            rules.append(f"{rule.measure} <= {rule.most}")
    stop = ", ".join(f"'{word}'" for word in dict.fromkeys(quality.STOP_WORDS))
    return rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (
    SELECT doc_id, text,
           list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
           list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM t),
k AS (SELECT row_number() OVER () AS r, * FROM s),
g AS (
    SELECT r, i, array_to_string(w[i:i + 7], ' ') AS g
    FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM k WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
covered AS (
    SELECT r, sum(least(8, coalesce(nxt - i, 8))) AS n_repeat_words
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
m AS (
    SELECT doc_id, len(w) AS n_words,
           length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
           length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
           len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
           len(list_filter(lines, lambda l: contains(l, ' | '))) AS n_bar_lines,
           len(list_filter(w, lambda x: lower(x) IN ({stop}))) AS n_stop,
           length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS upper,
           length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS letters,
           CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM k LEFT JOIN covered USING (r)),
v AS (
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
           CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
           CASE WHEN n_words > 0 THEN n_stop / n_words ELSE 0 END AS stop_ratio,
           CASE WHEN letters > 0 THEN upper / letters ELSE 0 END AS shout_ratio,
           CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
           CASE WHEN n_lines > 0 THEN n_bar_lines / n_lines ELSE 0 END AS bar_line_ratio
    FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(rules)} AS kept
FROM v
"""


def _spans(alias: str, pattern: str, group: int, least: int, kind: int) -> str:
    """Matches of a pattern with positions, from the pieces between them."""
    text = pattern.replace("'", "''")
    return rf"""{alias} AS (
    SELECT r, {kind} AS kind, start, start + length(whole[i]) AS stop, value[i] AS value
    FROM (
        SELECT r, i, gap, whole, value,
               list_sum(list_transform(gap[1:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start
        FROM (
            SELECT r, gap, whole, value, unnest(range(1, len(whole) + 1)) AS i
            FROM (
                SELECT r, string_split_regex(text, '{text}') AS gap, regexp_extract_all(text, '{text}', 0) AS whole,
                       regexp_extract_all(text, '{text}', {group}) AS value
                FROM k WHERE regexp_matches(text, '{text}'))))
    WHERE length(value[i]) >= {least})"""


def _secrets() -> str:
    names = [kind[0] for kind in secrets.KINDS] + ["bare"]
    found = [_spans(f"s{k}", *kind[1:], k) for k, kind in enumerate(secrets.KINDS)]
    wide = _spans("wide", secrets.BARE, 0, 20, len(secrets.KINDS))
    base = " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(len(secrets.KINDS)))
    name = "CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(names)) + " END"
    item = f"{name} || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
{", ".join(found)}, {wide},
base AS ({base}),
bare AS (
    SELECT * FROM wide w
    WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
      AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = w.r AND b.start < w.stop AND w.start < b.stop)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM bare),
owned AS (
    SELECT value, count(DISTINCT coalesce(source, chr(0))) >= {secrets.EXAMPLE_OWNERS} AS copied
    FROM every JOIN k USING (r) GROUP BY value),
judged AS (SELECT every.*, copied FROM every JOIN owned USING (value)),
per AS (
    SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
           count(*) FILTER (kind = 2) AS n_hex,
           string_agg({item}, ',' ORDER BY start, kind) FILTER (kind < {len(secrets.KINDS)}) AS base,
           string_agg({item}, ',' ORDER BY start, kind) FILTER (kind < {len(secrets.KINDS)} OR NOT copied) AS spans,
           count(*) FILTER (NOT copied) AS n_live,
           count(*) FILTER (copied AND kind < {len(secrets.KINDS)}) AS n_copied
    FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM k LEFT JOIN per USING (r)
"""


JACCARD = rf"""
WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
                                                  '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
    FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
    SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
    WHERE 100 * common >= 90 * (x.n + y.n - common)),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
component AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents JOIN component USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_NIBBLE = "(instr('0123456789abcdef', substr(sha1(coalesce(html, '')), CAST({0} AS BIGINT), 1)) - 1)"
_BASE32 = (
    "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((("
    + _NIBBLE.format("5 * i // 4 + 1") + " * 16 + " + _NIBBLE.format("5 * i // 4 + 2")
    + ") >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31 AS BIGINT) + 1, 1)), '')"
)

WARC = f"""
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_BASE32} AS payload_digest,
           min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
    FROM pages)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p
"""

SUFFIX = """
WITH d AS (
    SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, hex(coalesce(text, '')) AS h FROM documents),
w AS (
    SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) AS k
    FROM (SELECT doc_id, h, unnest(range(n_bytes - 99)) AS i FROM d WHERE n_bytes >= 100)),
later AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w)
    WHERE r > 1),
marked AS (
    SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 100 AS new FROM later),
numbered AS (SELECT doc_id, i, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM numbered GROUP BY doc_id, run),
edges AS (
    SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs
    UNION ALL SELECT doc_id, n_bytes, n_bytes, coalesce(max(b), 0) FROM d LEFT JOIN runs USING (doc_id)
    GROUP BY doc_id, n_bytes),
kept AS (
    SELECT doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a, b) AS h,
           sum(b - a) AS n_removed, count(*) - 1 AS n_spans
    FROM edges JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, CAST(n_removed AS BIGINT) AS n_removed, n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id)
"""


def _personal_data() -> str:
    """The patterns in their plain form; spans from the pieces between matches, checks and context of each."""
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
        "short_card": r"[0-9]([\x20-]?[0-9])+",
        "ssn": r"[0-9][0-9-]*",
    }
    luhn = (
        "list_sum(list_transform(range(1, length(digits) + 1), lambda i: "
        "CASE WHEN (length(digits) - i) % 2 = 0 THEN CAST(digits[i] AS INT) "
        "WHEN CAST(digits[i] AS INT) > 4 THEN 2 * CAST(digits[i] AS INT) - 9 ELSE 2 * CAST(digits[i] AS INT) END)) % 10 = 0"
    )
    moved = "substr(replace(value, ' ', ''), 5) || left(replace(value, ' ', ''), 4)"
    number = (
        f"array_to_string(list_transform(string_split({moved}, ''), "
        "lambda c: CASE WHEN c >= 'A' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), '')"
    )
    mod = (
        f"list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split({number}, ''), "
        "lambda c: CAST(c AS BIGINT))), lambda a, c: (a * 10 + c) % 97) = 1"
    )
    valid = {
        "email": "true",
        "ip": f"regexp_matches(value, '{pii.FOUR_BYTES}')",
        "card": f"CASE WHEN length(digits) BETWEEN 16 AND 19 THEN {luhn} ELSE false END",
        "phone": "length(digits) BETWEEN 8 AND 15",
        "iban": f"length(replace(value, ' ', '')) BETWEEN 15 AND 34 AND {mod}",
        "short_card": f"CASE WHEN length(digits) BETWEEN 13 AND 15 THEN {luhn} ELSE false END",
        "ssn": f"regexp_matches(value, '{pii.SOCIAL}')",
    }
    parts = []
    for i, kind in enumerate(pii.KINDS):
        pattern = plain[kind.name]
        near = f"regexp_matches(before || ' ' || after, '{pii.context(kind.words)}')"
        parts.append(rf"""
    SELECT r, {i} AS kind, start, start + length(value) AS stop,
           least(100, {kind.score} + CASE WHEN {near} THEN {pii.NEARBY} ELSE 0 END) AS score
    FROM (
        SELECT r, whole[i] AS value, regexp_replace(whole[i], '[^0-9]+', '', 'g') AS digits,
               right(gap[i], 32) AS before, left(gap[i + 1], 16) AS after,
               list_sum(list_transform(gap[1:i], lambda x: length(x)))
               + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0) AS start
        FROM (
            SELECT r, gap, whole, unnest(range(1, len(whole) + 1)) AS i
            FROM (
                SELECT r, string_split_regex(text, '{pattern}') AS gap, regexp_extract_all(text, '{pattern}', 0) AS whole
                FROM k WHERE regexp_matches(text, '{pattern}'))))
    WHERE {valid[kind.name]}""")
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{kind.name}'" for i, kind in enumerate(pii.KINDS)) + " END"
    item = f"{name} || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT)"
    base = ", ".join(str(i) for i, kind in enumerate(pii.KINDS) if kind.base)
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{kind.name}" for i, kind in enumerate(pii.KINDS) if kind.base)
    zeros = ", ".join(f"coalesce(n_{kind.name}, 0) AS n_{kind.name}" for kind in pii.KINDS if kind.base)
    return f"""
WITH k AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(parts)}),
per AS (
    SELECT r, {counts}, string_agg({item}, ',' ORDER BY kind, start) FILTER (kind IN ({base})) AS base,
           string_agg({item}, ',' ORDER BY kind, start) AS spans,
           string_agg(CAST(score AS VARCHAR), ',' ORDER BY kind, start) AS scores
    FROM found WHERE kind IN ({base}) OR score >= {pii.KEPT} GROUP BY r)
SELECT doc_id, {zeros}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(scores, '') AS scores
FROM k LEFT JOIN per USING (r)
"""


def _conversations() -> str:
    """The repair as a recursion over rows from the end; each state carries its cheapest cost and least audit."""
    crc_table = (
        "list_transform(range(256), lambda n: list_reduce(list_prepend(n, list_transform(range(8), lambda j: "
        "CAST(0 AS BIGINT))), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
    )
    needs, after = "uuau", (2, 2, 3, 2)

    def best(*ways: str) -> str:
        return f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1]"

    def way(cost: str, letter: str, state: str, when: str = "") -> str:
        value = f"{{'c': {cost} + {state}.c, 'a': '{letter}' || {state}.a}}"
        return f"CASE WHEN {when} THEN {value} END" if when else value

    plain = []
    for state in range(4):
        then = f"f{after[state]}"
        plain.append(
            best(
                way("3", "D", f"f{state}"),
                way("2 + late", "R", then, "NOT forced"),
                way("late", "K", then, f"NOT forced AND role[1] = '{needs[state]}'"),
                *([way("late", "K", "f1", "NOT forced AND role[1] = 's'")] if state == 0 else []),
            )
            + f" AS h{state}"
        )
    more = []
    for state in range(4):
        once, twice = f"h{after[state]}", f"h{after[after[state]]}"
        more.append(best(f"h{state}", way("2", "I", once), way("4", "II", twice)) + f" AS f{state}")
    return rf"""
WITH RECURSIVE
t AS MATERIALIZED (SELECT {crc_table} AS crc),
harmed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''),
               lambda ch: CAST(ascii(ch) AS BIGINT))),
               lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS harm
    FROM conversations, t),
left_over AS (
    SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
           CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM harmed),
numbered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role,
                                 sha256(length(role) || ':' || role || text)) AS i
    FROM left_over),
faulty AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault,
           lead(role) OVER (PARTITION BY conv_id ORDER BY i) AS next_role
    FROM numbered),
r AS MATERIALIZED (
    SELECT *, fault IN ('blank', 'duplicate') AS forced, CAST(fault = 'truncated' AS INT) AS late FROM faulty),
counted AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
           count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (next_role IS NOT NULL AND role[1] || next_role[1] NOT IN ('su', 'ua', 'au')) AS illegal,
           count(*) AS n
    FROM r GROUP BY conv_id),
f AS (
    SELECT conv_id, n AS i, {{'c': 0, 'a': ''}} AS f0, {{'c': 4, 'a': 'II'}} AS f1, {{'c': 2, 'a': 'I'}} AS f2,
           {{'c': 0, 'a': ''}} AS f3 FROM counted
    UNION ALL
    SELECT conv_id, i - 1, {", ".join(more)}
    FROM (
        SELECT f.conv_id, f.i, {", ".join(plain)}
        FROM f JOIN r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i)),
audited AS MATERIALIZED (SELECT conv_id, f0.c AS cost, f0.a AS audit FROM f WHERE i = 0),
letters AS (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, audit FROM audited),
placed AS (
    SELECT conv_id, p, audit[p] AS letter,
           count(*) FILTER (audit[p] <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS i,
           count(*) FILTER (audit[p] <> 'D') OVER (PARTITION BY conv_id ORDER BY p) AS line
    FROM letters),
kept AS (
    SELECT placed.conv_id, p, letter, line, role, CASE WHEN letter = 'I' THEN '' ELSE text END AS text,
           coalesce(bool_or(letter = 'K' AND line = 1 AND role[1] = 's') OVER (PARTITION BY placed.conv_id), false) AS led
    FROM placed LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM placed.conv_id AND r.i = placed.i
    WHERE letter <> 'D'),
repaired AS (
    SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (line - CAST(led AS INT)) % 2 = 1 THEN 'user'
                                    ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p) AS body
    FROM kept GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM ids.conv_id
     LEFT JOIN audited ON audited.conv_id IS NOT DISTINCT FROM ids.conv_id
     LEFT JOIN repaired ON repaired.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


SQL = {
    "op2_jaccard_join": JACCARD,
    "op4_decontamination": DECONTAMINATION,
    "op5_quality_rules": _quality(),
    "op7_secret_scan": _secrets(),
    "op8_warc": WARC,
    "op10_suffix_dedup": SUFFIX,
    "op12_personal_data": _personal_data(),
    "op13_conversation_repair": _conversations(),
}
