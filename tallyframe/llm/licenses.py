"""License scans of documents: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block contains a template when at least `percent` of the template's distinct words are in it. Blocks are windows of words,
whatever line breaks stand between them: one from each word of the template on, as long as a passage of which the template
is `percent`. A notice wrapped over lines is found, and words scattered over a long line are not. The join: template words are ordered by their frequency over all documents, rarest first; a template of m words that needs o of
them must share one of its m - o + 1 rarest words with the block (prefix filter); the block must have o template words
(length filter); and the words after the first shared one must still suffice on both sides (positional filter). The
templates are a short list given as a parameter; their words go to the tasks as literals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.common import folded, let, written
from tallyframe.llm.registry import query

# Phrases whose words stand one after the other, and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Sentences that common licenses ask to be quoted, as a user would list them
TEMPLATES = {
    "apache": "licensed under the apache license version 2 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "mit": "released under the mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "public-domain": "this work is dedicated to the public domain under cc0",
}

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Scan:
    percent: int = 80  # of a template's words in a block


def split_words(text: Column) -> Column:
    """The words of a folded text: runs of digits, a-z and every character beyond ASCII."""
    bare = F.regexp_replace(text, rf"^{BREAK}|{BREAK}$", "")
    return let(bare, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BREAK)))


def _phrase_places(words: Column) -> Column:
    """(label, start) of every place where a phrase stands; the words are only walked through if a phrase is in the text."""

    def places(phrase: str, label: str) -> Column:
        first, *rest = phrase.split(" ")

        def here(w: Column, i: Column) -> Column:
            same = w == first
            for k, word in enumerate(rest, start=1):
                same = same & (F.get(words, i + k) == word)
            return F.when(same, F.struct(F.lit(label).alias("label"), i.cast("bigint").alias("start")))

        return F.filter(F.transform(words, here), lambda x: x.isNotNull())

    parts = [places(p, label) for p, label in PHRASES.items()]
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    some = let(line, lambda t: F.greatest(*[F.contains(t, F.lit(f" {p} ")) for p in PHRASES]))
    return F.when(some, F.concat(*parts)).otherwise(F.array().cast("array<struct<label:string,start:bigint>>"))


def _vocabulary() -> list[str]:
    return sorted({w for t in TEMPLATES.values() for w in t.split(" ")})


def _windows(words: Column, label: str, scan: Scan) -> Column:
    """(label, block) of the word windows with as many template words as the template needs: from each of its words on, the
    different ones in the window. `words` are the (at, word) of all templates' words in the text, in order."""
    template = TEMPLATES[label].split(" ")
    need = -(-len(set(template)) * scan.percent // 100)
    length = len(template) * 100 // scan.percent
    own = F.filter(words, lambda w: w["word"].isin(sorted(set(template))))

    def from_each(hits: Column) -> Column:
        # the need-th word from here on must still stand in the window
        opens = F.filter(
            F.transform(hits, lambda h, i: F.struct(h["at"].alias("at"), i.alias("i"))),
            lambda o: F.coalesce(F.get(hits, o["i"] + (need - 1))["at"] < o["at"] + length, F.lit(False)),
        )
        inside = lambda o: F.filter(F.slice(hits, o["i"] + 1, length), lambda h: h["at"] < o["at"] + length)
        blocks = F.transform(opens, lambda o: F.array_sort(F.array_distinct(F.transform(inside(o), lambda h: h["word"]))))
        return F.transform(F.array_distinct(F.filter(blocks, lambda b: F.size(b) >= need)), lambda b: F.struct(F.lit(label).alias("label"), b.alias("block")))

    return let(own, from_each)


NO_BLOCKS = "array<struct<label:string,block:array<string>>>"


def _blocks(words: Column, scan: Scan) -> Column:
    """The windows of all templates. A template too few of whose words are in the text is not looked for, and without any such
    template the text's words are not walked through."""
    none = F.array().cast(NO_BLOCKS)
    vocabulary = _vocabulary()
    sets = {label: sorted(set(t.split(" "))) for label, t in TEMPLATES.items()}

    def enough(found: Column, label: str) -> Column:
        return F.size(F.array_intersect(F.array(*[F.lit(w) for w in sets[label]]), found)) * 100 >= len(sets[label]) * scan.percent

    def walked(found: Column) -> Column:
        at = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word")))
        known = F.filter(at, lambda w: w["word"].isin(vocabulary))
        parts = let(known, lambda k: F.concat(*[F.when(enough(found, label), _windows(k, label, scan)).otherwise(none) for label in TEMPLATES]))
        return F.when(F.greatest(*[enough(found, label) for label in TEMPLATES]), parts).otherwise(none)

    return let(F.array_intersect(F.array(*[F.lit(w) for w in vocabulary]), words), walked)


def measured(docs: DataFrame, text: str, scan: Scan) -> DataFrame:
    """The other columns of the rows, with n_words, places (of phrases), vocabulary (template words in the text) and blocks:
    of each window with enough template words, its template and those words. Small next to the texts, and all that the join
    needs."""
    vocabulary = F.array(*[F.lit(w) for w in _vocabulary()])
    t = folded(F.col(text))
    counted = let(split_words(t), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), _phrase_places(w).alias("places"), F.array_intersect(vocabulary, w).alias("vocabulary"),
        _blocks(w, scan).alias("blocks"),
    ))
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, counted.alias("counted")).select(*rest, "counted.*")


def template_matches(rows: DataFrame, row: str, scan: Scan) -> DataFrame:
    """(row, label, score): each template that a block of the row contains, with its largest share of words found."""
    counts = rows.select(F.explode("vocabulary").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("docs"))
    pairs = [F.struct(F.lit(label).alias("label"), F.lit(w).alias("word")) for label, t in TEMPLATES.items() for w in sorted(set(t.split(" ")))]
    listed = rows.sparkSession.range(1).select(F.inline(F.array(*pairs)))
    ordered = listed.join(counts, "word", "left").select("label", F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "word").alias("w"))
    templates = ordered.groupBy("label").agg(F.sort_array(F.collect_list("w")).alias("ws")).withColumn("size", F.size("ws"))
    templates = templates.withColumn("need", F.ceil(F.col("size") * scan.percent / 100).cast("int"))
    prefixes = templates.select(
        "label", F.col("ws.word").alias("words"), "size", "need", F.posexplode(F.slice("ws", F.lit(1), F.col("size") - F.col("need") + 1)).alias("rank", "w")
    ).select("label", "words", "size", "need", "rank", F.col("w.word").alias("word"))
    order = counts.agg(F.map_from_entries(F.collect_list(F.struct("word", "docs"))).alias("docs"))  # one entry per template word
    blocks = rows.select(row, F.inline("blocks")).join(F.broadcast(order))
    ranked = F.sort_array(F.transform("block", lambda w: F.struct(F.coalesce(F.try_element_at(F.col("docs"), w), F.lit(0)).alias("docs"), w.alias("word"))))
    blocks = blocks.select(row, "label", ranked["word"].alias("block"))
    tokens = blocks.select(row, "label", "block", F.posexplode("block").alias("place", "word"))
    met = tokens.join(F.broadcast(prefixes), ["label", "word"]).filter(
        (F.size("block") >= F.col("need")) & (F.least(F.col("size") - F.col("rank"), F.size("block") - F.col("place")) >= F.col("need"))
    )
    shared = F.size(F.array_intersect("block", "words"))
    return (
        met.withColumn("shared", shared).filter(F.col("shared") >= F.col("need"))
        .groupBy(row, "label").agg(F.max(F.col("shared") / F.col("size")).alias("score"))
    )


def with_licenses(docs: DataFrame, text: str = "text", scan: Scan = Scan()) -> DataFrame:
    """The other columns, with n_words, n_base, first_word, last_word, base_labels, labels and score of each row.

    labels are those of phrases and of contained templates; score is 1 where a phrase stands, else the largest share of a
    template's words in a block, 0 without a label. NULL is the empty text: no words, no labels. Repeated rows are judged
    each for itself.
    """
    numbered = written(measured(docs, text, scan).withColumn("at", F.monotonically_increasing_id()), "scanned")
    found = template_matches(numbered, "at", scan).groupBy("at").agg(F.collect_list("label").alias("found"), F.max("score").alias("found_score"))
    starts = F.col("places.start")
    base = F.array_sort(F.array_distinct("places.label"))
    rest = [c for c in docs.columns if c != text]
    all_ = F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>"))))
    return numbered.join(found, "at", "left").select(
        *rest, "n_words", F.size("places").cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(all_, ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("found_score", F.lit(0.0))).alias("score"),
    )


def _sql() -> str:
    templates = ", ".join(f"('{label}', '{t}')" for label, t in TEMPLATES.items())
    hits = " UNION ALL ".join(
        f"SELECT r, '{label}' AS label, i - 1 AS start FROM wi WHERE " + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(p.split(" ")))
        for p, label in PHRASES.items()
    )
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH dw AS (SELECT row_number() OVER () AS r, doc_id, {fold} AS t, regexp_extract_all({fold}, '{word}') AS ws FROM documents),
wi AS (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM dw),
hits AS ({hits}),
base AS (SELECT r, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY r),
tpl AS (SELECT label, list_distinct(string_split(t, ' ')) AS ws FROM (VALUES {templates}) AS v(label, t)),
lines AS (SELECT r, list_distinct(regexp_extract_all(l, '{word}')) AS ws FROM (SELECT r, unnest(string_split(t, chr(10))) AS l FROM dw)),
found AS (SELECT r, label, max(len(list_intersect(lines.ws, tpl.ws)) / len(tpl.ws)) AS score FROM lines, tpl
          WHERE 100 * len(list_intersect(lines.ws, tpl.ws)) >= {Scan().percent} * len(tpl.ws) GROUP BY r, label),
more AS (SELECT r, list(label) AS labels, max(score) AS score FROM found GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(score, 0.0) END::DOUBLE AS score
FROM dw LEFT JOIN base USING (r) LEFT JOIN more USING (r)"""


@query("op5_licenses", _sql())
def op5_licenses(spark, sf_dir):
    return with_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
