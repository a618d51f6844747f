"""Quality rules of documents, judged together with the host they come from.

Every text is measured by column expressions; each host's failure rate of a rule is shrunk towards the rate of all hosts
by a beta prior fitted to the hosts themselves; a host whose shrunken rate is over the limit is distrusted for that rule,
and a document of such a host that breaks the rule is rejected. A document of any host that breaks a base rule is
rejected; one that breaks no rule is never rejected, whatever its host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import SPACE, free_name, let, raw_words, written
from tallyframe.llm.registry import query


@dataclass(frozen=True)
class Rules:
    """Limits in whole numbers: a rule breaks when 100 * count > limit * base count."""

    min_words: int = 50
    repeat_percent: int = 50
    symbol_percent: int = 40  # symbols against words
    line_percent: int = 30  # repeated lines against lines
    host_percent: int = 50  # shrunken rate above which a host is distrusted for a rule


SOFT = ("symbols", "lines")
_FEW = 64  # repeated windows looked up one by one; more are found by sorting, with the same result


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text, the first occurrence included."""

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.coalesce(F.least(F.lit(3), F.get(at, i + 1) - p), F.lit(3)))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def few(keys: Column, twice: Column) -> Column:
        return F.filter(F.transform(keys, lambda k, i: F.when(F.array_contains(twice, k), i)), lambda p: p.isNotNull())

    def many(keys: Column) -> Column:
        ranked = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return let(
            ranked,
            lambda r: F.sort_array(
                F.filter(
                    F.transform(
                        r,
                        lambda x, i: F.when(
                            (F.get(r, i - 1)["k"] == x["k"]) | (F.get(r, i + 1)["k"] == x["k"]), x["i"]
                        ),
                    ),
                    lambda p: p.isNotNull(),
                )
            ),
        )

    def among(keys: Column) -> Column:
        twice = let(
            F.sort_array(keys), lambda s: F.array_distinct(F.filter(s, lambda k, i: (i > 0) & (F.get(s, i - 1) == k)))
        )
        at = lambda t: F.when(F.size(t) <= _FEW, few(keys, t)).otherwise(many(keys))
        return let(twice, lambda t: F.when(F.size(t) == 0, 0).otherwise(let(at(t), covered)))

    keys = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
    )
    return F.when(F.size(words) < 4, 0).otherwise(let(keys, among))


def measures(text: Column, rules: Rules = Rules()) -> Column:
    """Counts of one text and the rules it breaks, as a struct. NULL counts as the empty text: no words, base rule broken."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(
        raw_words(t), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("repeated"))
    )
    line_counts = let(
        lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))
    )
    raw = F.struct(
        counted.alias("words"), F.char_length(F.regexp_replace(t, SPACE + "+", "")).alias("chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).alias("symbols"), line_counts.alias("lines"),
    )
    n, repeated = lambda r: r["words"]["n"], lambda r: r["words"]["repeated"]
    return let(raw, lambda r: F.struct(
        n(r).cast("bigint").alias("n_words"), r["chars"].cast("bigint").alias("word_chars"),
        r["symbols"].cast("bigint").alias("n_symbols"), r["lines"]["dup"].cast("bigint").alias("n_dup_lines"),
        repeated(r).cast("bigint").alias("n_repeat_words"),
        ((n(r) < rules.min_words) | (repeated(r) * 100 > n(r) * rules.repeat_percent)).alias("base_failed"),
        (r["symbols"] * 100 > n(r) * rules.symbol_percent).alias("symbols"),
        (r["lines"]["dup"] * 100 > r["lines"]["n"] * rules.line_percent).alias("lines"),
    ))


def host_verdicts(measured: DataFrame, host: str, measure: str, rules: Rules = Rules()) -> DataFrame:
    """One row per host: documents, failures, and for each soft rule whether the host is distrusted.

    The prior has the hosts' mean rate m and the strength m(1-m)/v - 1 of their variance v (not below 0). If all hosts
    have one rate (v = 0, also with a single host) the shrunken rate is m. NULL is a host like any other.
    """
    broken = {r: F.col(measure)[r] for r in SOFT}
    hosts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"f_{r}") for r, c in broken.items()]
    )
    hosts = written(hosts, "host-counts")
    prior = hosts.agg(*[
        f(F.col(f"f_{r}") / F.col("n")).alias(f"{a}_{r}") for r in SOFT for a, f in (("m", F.avg), ("v", F.var_pop))
    ])
    out = hosts.join(F.broadcast(prior))  # one row
    for r in SOFT:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(0.0)))
        shrunk = F.when(strength.isNull(), m).otherwise((F.col(f"f_{r}") + strength * m) / (F.col("n") + strength))
        out = out.withColumn(f"distrusted_{r}", shrunk * 100 > rules.host_percent)
    return out.select("host", "n", *[f"f_{r}" for r in SOFT], *[f"distrusted_{r}" for r in SOFT])


def _kept(measure: Column, verdicts: Column) -> Column:
    bad = F.lit(False)
    for r in SOFT:
        bad = bad | (measure[r] & verdicts[f"distrusted_{r}"])
    return ~(measure["base_failed"] | F.coalesce(bad, F.lit(False)))


def _with_hosts(docs: DataFrame, host: str, hosts: DataFrame, name: str) -> DataFrame:
    return docs.join(hosts.select(F.struct("*").alias(name)), docs[host].eqNullSafe(F.col(f"{name}.host")), "left")


def judged(docs: DataFrame, host: str, measure: str, verdict: str, rules: Rules = Rules()) -> DataFrame:
    """The rows with the boolean column `verdict`: true for a document to keep. `measure` is the struct of `measures`."""
    name = free_name(docs, "host_verdict")
    joined = _with_hosts(docs, host, host_verdicts(docs, host, measure, rules), name)
    return joined.withColumn(verdict, _kept(F.col(measure), F.col(name))).drop(name)


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the rules keep, with their columns as they were. The texts are measured twice, for
    the hosts and for the verdicts, and moved only if the table of hosts is too large to be sent to all."""
    small = written(docs.select("source", measures(F.col("text")).alias("m")), "measures")
    name = free_name(docs, "host_verdict")
    joined = _with_hosts(docs, "source", host_verdicts(small, "source", "m"), name)
    return joined.filter(let(measures(F.col("text")), lambda m: _kept(m, F.col(name)))).select(*docs.columns)


KEPT_SQL = r"""
t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM {docs}),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls,
        row_number() OVER () AS r FROM t),
tri AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
        FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
hit AS (SELECT r, i FROM tri WHERE true QUALIFY count(*) OVER (PARTITION BY r, k) > 1),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM hit, range(3) AS x(o) GROUP BY r),
m AS (SELECT doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
        CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, len(ls) AS n_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, w.r FROM w LEFT JOIN rep USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, 100 * n_symbols > 40 * n_words AS bs,
        100 * n_dup_lines > 30 * n_lines AS bl FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (bs) AS fs, count(*) FILTER (bl) AS fl FROM b GROUP BY source),
p AS (SELECT avg(fs / n) AS ms, var_pop(fs / n) AS vs, avg(fl / n) AS ml, var_pop(fl / n) AS vl FROM h),
d AS (SELECT source,
        100 * CASE WHEN vs > 0 THEN (fs + greatest(ms * (1 - ms) / vs - 1, 0) * ms) / (n + greatest(ms * (1 - ms) / vs - 1, 0)) ELSE ms END > 50 AS ds,
        100 * CASE WHEN vl > 0 THEN (fl + greatest(ml * (1 - ml) / vl - 1, 0) * ml) / (n + greatest(ml * (1 - ml) / vl - 1, 0)) ELSE ml END > 50 AS dl
        FROM h, p),
verdicts AS (SELECT b.*, NOT (base_failed OR (bs AND ds) OR (bl AND dl)) AS kept FROM b JOIN d ON b.source IS NOT DISTINCT FROM d.source)
"""

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@query(
    "op2_host_rules",
    "WITH " + KEPT_SQL.format(docs="documents") + f"SELECT doc_id, {', '.join(COUNTS)}, base_failed, kept FROM verdicts",
)
def op2_host_rules(spark, sf_dir):
    """Every document with its counts and whether the rules keep it. The counts are written once, without the texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", measures(F.col("text")).alias("m"))
    out = judged(written(docs, "measures"), "source", "m", "kept")
    return out.select("doc_id", *[F.col("m")[c].alias(c) for c in (*COUNTS, "base_failed")], "kept")
