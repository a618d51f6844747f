"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby raise or lower their score.

Everything is column expressions. A pattern cuts a text into the pieces between its matches, so the places of all matches are
running sums of lengths, found in one pass whatever the number of matches. Patterns neither nest repeated groups nor try a
run of characters again from its middle: their time is linear and their stack flat on any text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import free_name, let
from tallyframe.llm.registry import query

NEAR = 40  # characters on either side of a span that are searched for context words
ENOUGH = 60  # the score of 0 to 100 that an added span must reach; base spans stay whatever their score
RAISED, LOWERED = 30, 20

# Account number lengths by country
IBAN_LENGTHS = {
    15: ("NO",), 16: ("BE",), 18: ("DK", "FI", "NL"), 20: ("AT", "EE", "LT", "LU"), 21: ("CH", "HR", "LV"), 22: ("BG", "DE", "GB", "IE"),
    24: ("CZ", "ES", "RO", "SE", "SK"), 25: ("PT",), 26: ("IS",), 27: ("FR", "GR", "IT"), 28: ("CY", "HU", "PL"),
}

_WORDISH = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # letters, digits, anything beyond ASCII
_BYTE = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    """How one kind of data is found. `pattern` matches it; if `gaps` is set, `pattern` matches what stands between instead.
    `gate` is a cheap condition on a text without which nothing can match. `valid` judges a match, and for kinds that need
    free ends so do its neighbours. `near` and `against` are words that raise and lower the score."""

    name: str
    pattern: str
    gate: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    prior: int
    near: str
    against: str = r"example|sample|test|dummy"
    base: bool = True
    gaps: bool = False
    free_ends: bool = False


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has the check digit of payment cards: every second digit from the right is doubled."""
    turned = F.reverse(number)

    def total(t: Column) -> Column:
        doubled = F.translate(t, "0123456789", "0246813579")
        at = lambda i: F.when(i % 2 == 1, F.substring(t, i, F.lit(1))).otherwise(F.substring(doubled, i, F.lit(1)))
        return F.aggregate(F.sequence(F.lit(1), F.char_length(t)), F.lit(0), lambda a, i: a + at(i).cast("int"))

    return F.when(F.char_length(number) > 0, let(turned, total) % 10 == 0).otherwise(False)


def mod97(account: Column) -> Column:
    """Whether an account number without blanks leaves 1 modulo 97, its first four characters moved to the end."""
    moved = F.concat(F.substring(account, 5, 64), F.substring(account, 1, 4))

    def rest(t: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            c = F.ascii(F.substring(t, i, F.lit(1)))
            return F.when(c < 58, (a * 10 + c - 48) % 97).otherwise((a * 100 + c - 55) % 97)

        return F.aggregate(F.sequence(F.lit(1), F.char_length(t)), F.lit(0), step)

    return F.when(F.char_length(account) > 4, let(moved, rest) == 1).otherwise(False)


def _card(m: Column) -> Column:
    return let(F.translate(m, " -", ""), lambda d: F.when(F.char_length(d).between(13, 19), luhn(d)).otherwise(False))


_IBAN = "|".join(f"(?:{'|'.join(c)})[0-9][0-9](?: ?[0-9A-Z]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

KINDS = (
    Kind(
        "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+",
        lambda t: t.contains("@"), lambda m: F.lit(True), 80, r"e-?mail|mailto|contact|write to",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"),
        lambda m: m.rlike(rf"^0*{_BYTE}\.0*{_BYTE}\.0*{_BYTE}\.0*{_BYTE}$"), 60, r"\bip\b|address|server|host", r"version|chapter|section",
    ),
    # between card numbers stand two or more characters that are no digits, or one that is neither blank nor hyphen
    Kind(
        "card", r"\A[^0-9]++|[^0-9]++\z|[^0-9]{2,}+|[^0-9 -]", lambda t: t.rlike(r"(?:[0-9][ -]?){12}[0-9]"), _card, 80,
        r"card|visa|credit|payment|account", gaps=True,
    ),
    Kind(
        "phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: t.contains("+"), lambda m: F.char_length(digits(m)).between(9, 15), 70,
        r"phone|call|tel|mobile|fax",
    ),
    Kind(
        "iban", _IBAN, lambda t: t.rlike("[A-Z][A-Z][0-9][0-9]"), lambda m: mod97(F.translate(m, " ", "")), 80, r"iban|account|bank|transfer",
        base=False, free_ends=True,
    ),
    Kind(
        "ssn", r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]", lambda t: t.rlike("[0-9]-[0-9][0-9]-[0-9]"),
        lambda m: ~m.rlike("^(?:000|666|9)|-00-|0000$"), 40, r"ssn|social security|taxpayer", base=False, free_ends=True,
    ),
)

SPAN = "struct<start:int,end:int,score:int>"


def _score(kind: Kind, before: Column, after: Column) -> Column:
    around = F.lower(F.concat_ws(" ", F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR))))
    raised = F.when(around.rlike(kind.near), RAISED).otherwise(0)
    lowered = F.when(around.rlike(kind.against), LOWERED).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.lit(kind.prior) + raised - lowered))


def spans(text: Column, kind: Kind) -> Column:
    """The spans of one kind in a text that is not NULL, in order: start, end (in characters, exclusive) and score."""
    none = F.array().cast(f"array<{SPAN}>")

    def placed(cut: Column) -> Column:
        between, matched = (cut["other"], cut["pieces"]) if kind.gaps else (cut["pieces"], cut["other"])

        def judged(m: Column, i: Column) -> Column:
            before = F.coalesce(F.get(between, i - 1 if kind.gaps else i), F.lit(""))
            after = F.coalesce(F.get(between, i if kind.gaps else i + 1), F.lit(""))
            good = kind.valid(m)
            if kind.free_ends:
                good = good & ~before.rlike(_WORDISH + "$") & ~after.rlike("^" + _WORDISH)
            score = F.when(good, _score(kind, before, after))
            if not kind.base:
                score = F.when(score >= ENOUGH, score)
            return F.struct(F.char_length(before).alias("gap"), F.char_length(m).alias("size"), score.alias("score"))

        def step(a: Column, m: Column) -> Column:
            start = a["at"] + m["gap"]
            own = F.array(F.struct(start.alias("start"), (start + m["size"]).alias("end"), m["score"].alias("score")))
            return F.struct(
                (start + m["size"]).alias("at"),
                F.when(m["score"].isNotNull(), F.concat(a["found"], own)).otherwise(a["found"]).cast(f"array<{SPAN}>").alias("found"),
            )

        first = F.struct(F.lit(0).alias("at"), none.alias("found"))
        return F.aggregate(F.transform(matched, judged), first, step, lambda a: a["found"])

    # pieces: what stands between the matches, one more than matches
    cut = F.struct(F.split(text, kind.pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("other"))
    return F.when(kind.gate(text), let(cut, placed)).otherwise(none)


def with_spans(docs: DataFrame, text: str = "text", column: str = "spans", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Adds a struct with an array of spans for each kind. NULL is the empty text, which has none; equal rows get equal spans.
    The struct is bound once, so that reading its fields does not search the text again."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.withColumn(column, let(F.struct(*[spans(t, k).alias(k.name) for k in kinds]), lambda found: found))


def masked(text: Column, found: Column, kinds: tuple[Kind, ...] = KINDS) -> Column:
    """The text with every span replaced by its kind in brackets; of spans that overlap the first (the longer, of two that
    start together) names the kind, and all of them go. NULL stays NULL."""
    def named(kind: Kind) -> Column:
        return F.transform(found[kind.name], lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.lit(kind.name).alias("kind")))

    every = F.sort_array(F.flatten(F.array(*[named(k) for k in kinds])))

    def step(a: Column, s: Column) -> Column:
        end = -s["end"]
        new = F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(F.greatest(a["at"], end).alias("at"), F.when(s["start"] >= a["at"], new).otherwise(a["out"]).alias("out"))

    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.when(text.isNotNull(), F.aggregate(every, first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.char_length(text)))))


def listed(found: Column, kinds: list[Kind]) -> Column:
    """kind:start:end of all spans, by kind and start, joined by commas."""

    def named(kind: Kind) -> Column:
        return F.transform(found[kind.name], lambda s: F.concat_ws(":", F.lit(kind.name), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.flatten(F.array(*[named(k) for k in kinds])), ",")


# ---- the same rows in SQL: matches and the pieces between them, lengths summed per match ---------------------------

_SQL_VALID = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 ELSE CAST('0' || ltrim(x, '0') AS INT) END)) <= 255",
    "card": """length(regexp_replace(m, '[ -]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(regexp_replace(m, '[ -]', '', 'g')), ''),
                 lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE (CAST(c AS INT) * 2) // 10 + (CAST(c AS INT) * 2) % 10 END)) % 10 = 0""",
    "phone": "length(regexp_replace(m, '[^0-9]', '', 'g')) BETWEEN 9 AND 15",
    "iban": """list_reduce(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''),
                 lambda c: CASE WHEN ascii(c) < 58 THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, d: (a * (CASE WHEN d > 9 THEN 100 ELSE 10 END) + d) % 97, 0) = 1""",
    "ssn": "NOT regexp_matches(m, '^(000|666|9)|-00-|0000$')",
}
_SQL_PATTERN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": _IBAN, "ssn": r"[0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9][0-9][0-9]",
}


def _sql(kind: Kind) -> str:
    near = f"(lower(right(b, {NEAR})) || ' ' || lower(left(a, {NEAR})))"
    score = f"{kind.prior} + CASE WHEN regexp_matches({near}, '{kind.near}') THEN {RAISED} ELSE 0 END - CASE WHEN regexp_matches({near}, '{kind.against}') THEN {LOWERED} ELSE 0 END"
    free = f"AND NOT regexp_matches(b, '{_WORDISH}$') AND NOT regexp_matches(a, '^{_WORDISH}')" if kind.free_ends else ""
    return f"""
{kind.name}_x AS (SELECT r, regexp_extract_all(text, '{_SQL_PATTERN[kind.name]}') AS f, regexp_split_to_array(text, '{_SQL_PATTERN[kind.name]}') AS s FROM t),
{kind.name}_m AS (SELECT r, f[i] AS m, s[i] AS b, s[i + 1] AS a,
   CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS st
   FROM (SELECT r, f, s, unnest(range(1, len(f) + 1)) AS i FROM {kind.name}_x)),
{kind.name} AS (SELECT r, count(*) AS n, string_agg('{kind.name}:' || st || ':' || (st + length(m)), ',' ORDER BY st) AS l
   FROM {kind.name}_m WHERE {_SQL_VALID[kind.name]} {free} {'' if kind.base else f'AND {score} >= {ENOUGH}'} GROUP BY r)"""


_BASE = [k for k in KINDS if k.base]
_LISTS = ", ".join(f"{k.name}.l" for k in KINDS)

SQL = (
    "WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents)," + ",".join(_sql(k) for k in KINDS)
    + "\nSELECT doc_id, " + ", ".join(f"coalesce({k.name}.n, 0) AS n_{k.name}" for k in _BASE)
    + f", sha256(concat_ws(',', {', '.join(f'{k.name}.l' for k in _BASE)})) AS base_sha256, concat_ws(',', {_LISTS}) AS spans\nFROM t "
    + " ".join(f"LEFT JOIN {k.name} USING (r)" for k in KINDS)
)


@query("op13_personal_data", SQL)
def op13_personal_data(spark, sf_dir):
    """Every document with its spans; NULL and empty texts have none, repeated rows are rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = free_name(docs, "found")
    rows = with_spans(docs, column=found).select("doc_id", found)
    base = [k for k in KINDS if k.base]
    return rows.select(
        "doc_id", *[F.size(F.col(found)[k.name]).cast("bigint").alias(f"n_{k.name}") for k in base],
        F.sha2(listed(F.col(found), base), 256).alias("base_sha256"), listed(F.col(found), list(KINDS)).alias("spans"),
    )
