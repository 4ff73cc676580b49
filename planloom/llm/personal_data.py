r"""Personal data (9): patterns propose spans, checksums confirm them, nearby words adjust the score. DataFrame functions only.

Per kind, matches are leftmost and do not overlap; a match that its validator refuses is dropped without a retry.
Base kinds: email, ip (parts at most 255), card (13 to 19 digits passing Luhn), phone (9 to 15 digits). They stay
whatever their score. Added kinds: iban (mod 97, spaces allowed, as long as its country's are), ssn. Offsets count code
points, end exclusive.

score: 0.4 for the pattern, 0.4 for a passed checksum, 0.3 for a context word of the kind, -0.3 for a word that speaks of
examples, within CONTEXT characters on either side (at least 0, at most 1). The match of the same kind before the span
counts as one character there, so that a word serves two in a list; the other side ends at the next match.
Words count whole, in any case. An added span stays from 0.6 on: an ssn needs a context word, an iban no word of examples.

The patterns are possessive and start only where a run of their characters starts (or the last match ended): that
finds the same matches as plain backtracking does, in time linear in the text. Offsets are running sums, taken by blocks
of blocks of BLOCK lengths, so n matches cost little more than 2 * BLOCK * n steps. Null and empty texts have no spans;
an empty table gives no rows; repeated rows each get a row; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import table

CONTEXT = 40
KEPT_FROM = 0.6
#: Words that make a span unlikely to be anyone's.
EXAMPLES = "example|sample|dummy|placeholder|test"
#: Lengths that a running sum adds one by one.
BLOCK = 64


class Kind(NamedTuple):
    name: str
    #: Cheap test that every text with a match passes.
    gate: Callable[[Column], Column]
    pattern: str
    valid: Callable[[Column], Column]
    checksum: bool
    context: str
    base: bool


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _digit(digits: Column, from_right: Column) -> Column:
    return F.substring(digits, -from_right, F.lit(1)).cast("int")


def luhn(digits: Column) -> Column:
    doubled = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.when(i % 2 == 1, _digit(digits, i)).otherwise((_digit(digits, i) * 2) % 10 + F.floor(_digit(digits, i) / 5).cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


# How many characters follow the country and the two check digits of an account number.
IBAN_LENGTHS = {
    "NO": 11, "BE": 12, "DK|FI|FO|GL|NL": 14, "MK|SI": 15, "AT|BA|EE|KZ|LT|LU|XK": 16, "CH|CR|HR|LI|LV": 17, "BG|BH|DE|GB|GE|IE|ME|RS|VA": 18, "AE|GI|IL|IQ|TL": 19,
    "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG": 20, "PT|ST": 21, "IS|TR": 22, "FR|GR|IT|MC|MR|SM": 23, "AL|AZ|BY|CY|DO|GT|HU|LB|PL|SV": 24, "BR|PS|QA|UA": 25, "JO|KW|MU": 26, "MT|SC": 27, "LC": 28,
}
#: A known country's number ends where its length says, whatever follows; others, and broken off ones, are taken as far as they go.
_KNOWN = "|".join(rf"(?:{countries})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n}}}" for countries, n in IBAN_LENGTHS.items())
IBAN = rf"(?:{_KNOWN}|[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{11,30}})"


def mod97(iban: Column) -> Column:
    """Whether the account number, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    moved = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))
    code = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.ascii(F.substring(moved, i, F.lit(1))))
    return F.aggregate(code, F.lit(0), lambda a, c: F.when(c < 65, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)) == 1


def _card(match: Column) -> Column:
    digits = _digits(match)
    return F.length(digits).between(13, 19) & luhn(digits)


def _part(match: Column, k: int) -> Column:
    part = F.regexp_replace(F.split_part(match, F.lit("."), F.lit(k)), "^0+(?=[0-9])", "")
    return (F.length(part) <= 3) & (F.substring(part, 1, 3).cast("int") <= 255)


KINDS = (
    Kind("email", lambda t: F.contains(t, F.lit("@")), r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda m: F.lit(True), False, "mail|contact|write to", True),
    Kind("ip", lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda m: _part(m, 1) & _part(m, 2) & _part(m, 3) & _part(m, 4), False, "ip|host|server|address", True),
    Kind("card", lambda t: F.rlike(t, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}")), r"[0-9](?:[\x20-]?[0-9]){12,}+", _card, True, "card|visa|master|pay", True),
    Kind("phone", lambda t: F.contains(t, F.lit("+")), r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: F.length(_digits(m)).between(9, 15), False, "phone|call|tel|mobile", True),
    Kind("iban", lambda t: F.rlike(t, F.lit(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11}")), IBAN, lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))), True, "iban|account|bank", False),
    Kind("ssn", lambda t: F.rlike(t, F.lit(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")), r"[0-9]{3}-[0-9]{2}-[0-9]{4}", lambda m: F.lit(True), False, "ssn|social security", False),
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def running(numbers: Column, body: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """body of a function that gives the sum of the first i numbers, for i up to their number."""
    blocks = lambda of: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(of) / BLOCK).cast("int") - 1, F.lit(0))), lambda j: total(F.slice(of, j * BLOCK + 1, F.lit(BLOCK)))
    )
    rest = lambda of, i: total(F.slice(of, i - i % BLOCK + 1, i % BLOCK))

    def with_blocks(small: Column, large: Column) -> Column:
        def first(i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            return rest(numbers, i) + rest(small, block) + total(F.slice(large, F.lit(1), F.floor(block / BLOCK).cast("int")))

        return body(first)

    return let(blocks(numbers), lambda small: let(blocks(small), lambda large: with_blocks(small, large)))


def proposed(text: Column, pattern: str) -> Column:
    """Array of (start, end, match, before, after): what lies between the matches gives their offsets and their context."""
    none = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")

    def spans(matches: Column, gaps: Column) -> Column:
        lengths = F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))

        def with_lengths(sizes: Column) -> Column:
            def of(upto: Callable[[Column], Column]) -> Column:
                return F.transform(
                    F.sequence(F.lit(0), F.size(matches) - 1),
                    lambda i: let(
                        upto(i) + F.get(sizes, i)["g"],
                        lambda start: F.struct(
                            start.alias("start"),
                            (start + F.get(sizes, i)["m"]).alias("end"),
                            F.get(matches, i).alias("match"),
                            F.substring(F.concat(F.coalesce(F.get(gaps, i - 1), F.lit("")), F.lit("|"), F.get(gaps, i)), -CONTEXT, CONTEXT).alias("before"),
                            F.substring(F.get(gaps, i + 1), 1, CONTEXT).alias("after"),
                        ),
                    ),
                )

            return let(F.transform(sizes, lambda s: s["g"] + s["m"]), lambda both: running(both, of))

        return let(lengths, with_lengths)

    return let(
        F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")),
        lambda parts: F.when(F.size(parts["m"]) > 0, let(parts["m"], lambda m: let(parts["g"], lambda g: spans(m, g)))).otherwise(none),
    )


def _says(context: Column, words: str) -> Column:
    return F.rlike(F.lower(context), F.lit(f"(?:^|[^a-z0-9])(?:{words})(?:$|[^a-z0-9])"))


def spans_of(text: Column, kind: Kind) -> Column:
    """Array of (kind, start, end, score) of one kind."""

    def scored(s: Column) -> Column:
        near = F.concat_ws(" | ", s["before"], s["after"])
        percent = F.lit(80 if kind.checksum else 40) + F.when(_says(near, kind.context), 30).otherwise(0) - F.when(_says(near, EXAMPLES), 30).otherwise(0)
        score = F.least(F.greatest(percent, F.lit(0)), F.lit(100)) / 100
        return F.struct(F.lit(kind.name).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), score.alias("score"))

    found = F.transform(F.filter(proposed(text, kind.pattern), lambda s: kind.valid(s["match"])), scored)
    if not kind.base:
        found = F.filter(found, lambda s: s["score"] >= KEPT_FROM)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,score:double>>")
    return F.when(kind.gate(text), found).otherwise(none)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and, for each kind, its array of (kind, start, end, score)."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("doc_id", *(spans_of(F.col("text"), kind).alias(kind.name) for kind in KINDS))


def _joined(kinds: list[str]) -> Column:
    each = F.transform(F.concat(*kinds), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(each, ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    base = [k.name for k in KINDS if k.base]
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined([k.name for k in KINDS]).alias("spans"),
        F.array_join(F.transform(F.concat(*(k.name for k in KINDS)), lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",").alias("scores"),
    )


#: The plain patterns, for DuckDB, and what their matches have to pass.
_PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda p: TRY_CAST(p AS HUGEINT) <= 255)) = 4"),
    "card": (r"[0-9]([\x20-]?[0-9])+", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, 1 + length(regexp_replace(m, '[^0-9]', '', 'g'))), lambda i: CASE WHEN i % 2 = 1 THEN CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][1 + CAST(reverse(regexp_replace(m, '[^0-9]', '', 'g'))[i] AS INT)] END)) % 10 = 0"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15"),
    "iban": (IBAN, "list_reduce(list_transform(range(1, 1 + length(replace(m, ' ', ''))), lambda i: ascii((replace(m, ' ', '')[5:] || replace(m, ' ', '')[:4])[i])), lambda a, c: CASE WHEN c < 65 THEN (a * 10 + c - 48) % 97 ELSE (a * 100 + c - 55) % 97 END, 0) = 1 AND score >= 60"),
    "ssn": (r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "score >= 60"),
}


def _oracle() -> str:
    parts, names, base = [], [], [k.name for k in KINDS if k.base]
    says = lambda words: f"CASE WHEN regexp_matches(near, '(?:^|[^a-z0-9])(?:{words})(?:$|[^a-z0-9])') THEN 30 ELSE 0 END"
    for i, (kind, (pattern, valid)) in enumerate(_PLAIN.items()):
        of = next(k for k in KINDS if k.name == kind)
        parts.append(f"""{kind}_m AS (
  SELECT *, least(greatest({80 if of.checksum else 40} + {says(of.context)} - {says(EXAMPLES)}, 0), 100) AS score FROM (
  SELECT id, i, m[i] AS m, lower(right(coalesce(g[i - 1], '') || '|' || g[i], 40) || ' | ' || left(g[i + 1], 40)) AS near,
         CAST(coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
  FROM (SELECT id, m, g, unnest(range(1, 1 + len(m))) AS i
        FROM (SELECT id, regexp_extract_all(text, '{pattern}') AS m, string_split_regex(text, '{pattern}') AS g FROM d)))
), {kind} AS (
  SELECT id, {i} AS k, '{kind}' AS kind, s, s + length(m) AS e, score FROM {kind}_m WHERE {valid}
)""")
        names.append(f"SELECT * FROM {kind}")
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in base)
    return f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(parts)}, every AS ({" UNION ALL ".join(names)}),
s AS (
  SELECT id, {counts},
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < {len(base)}) AS base,
         string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans,
         string_agg(CAST(score AS VARCHAR), ',' ORDER BY k, s) AS scores
  FROM every GROUP BY id
)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(scores, '') AS scores
FROM d LEFT JOIN s USING (id)
"""


ORACLE_SQL = _oracle()
