"""Benchmark decontamination with suffix arrays over the training texts.

Every task cuts its documents into shards of a few MB, sorts each shard's word suffixes, and searches all suffixes of the
benchmark's items in that array at once, word by word: the range of suffixes that share the words so far narrows until it
is empty, which gives the longest verbatim match and, at the length of a window, all places of the window. The benchmark is
read in blocks of bounded size; each block is one more pass over the documents.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import words as W
from tallyframe.llm.common import free_name, total
from tallyframe.llm.registry import query

WINDOW = 10
BLOCK_BYTES = 4 << 20  # of item texts sent to the tasks at once

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("longest", T.LongType()),  # words of the longest verbatim match, if of a window's length
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("starts", T.ArrayType(T.LongType())),  # runs of hit words: first word, and the word after the last
    T.StructField("ends", T.ArrayType(T.LongType())),
])
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("longest", pa.int64()), ("items", pa.list_(pa.string())),
    ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())),
])


class Items:
    """The words of some benchmark items one after the other. `ends[i]` is the end of the item that word i is in, `need[i]`
    the length of a window there (0 where none starts)."""

    def __init__(self, ids: list, texts: list, window: int):
        w = W.words(pa.array(texts, pa.large_string()), W.LETTERS_DIGITS)
        lengths = np.diff(w.first)
        self.ids = np.array([None if i is None else str(i) for i in ids], dtype=object)
        self.hash, self.item = w.hash, w.doc
        self.ends = w.first[1:][w.doc]
        left = self.ends - np.arange(len(w.hash))
        need = np.minimum(window, lengths)[w.doc]
        self.need = np.where(left >= need, need, 0)
        self.shortest = int(self.need[self.need > 0].min()) if len(self.need) else 0
        firsts = np.flatnonzero(self.need)
        self.heads = np.unique(_pairs(self.hash, self.hash[1:], firsts) if self.shortest > 1 else self.hash[firsts])


def _pairs(first: np.ndarray, second: np.ndarray, at: np.ndarray) -> np.ndarray:
    return W.mixed(first[at] * np.uint64(3) + second[at])


def suffix_order(ids: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The positions `at` in the order of the suffixes of `ids` that start there, compared up to `depth` words. Only groups
    that are still tied are compared further, word by word."""
    base = int(ids.max()) + 2 if len(ids) else 2
    padded = np.append(ids + 1, np.zeros(depth, ids.dtype))
    at = at[np.argsort(padded[at], kind="stable")]
    key = padded[at]
    rank = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])[np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1]
    for d in range(1, depth):
        new = np.r_[True, rank[1:] != rank[:-1]]
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(tied):
            break
        key = rank[tied] * base + padded[at[tied] + d]
        order = np.argsort(key, kind="stable")
        at[tied] = at[tied][order]
        key = key[order]
        fresh = np.r_[True, key[1:] != key[:-1]]
        rank[tied] = tied[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    return at


def _edge(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """For each query the first place in [lo, hi) whose word is not below `want` (right: is above it)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) >> 1
        found = words[mid]
        below = found <= want[open_] if right else found < want[open_]
        lo[open_] = np.where(below, mid + 1, lo[open_])
        hi[open_] = np.where(below, hi[open_], mid)


def search(ids: np.ndarray, order: np.ndarray, test: np.ndarray, ends: np.ndarray, need: np.ndarray):
    """Longest match of each test suffix, and the range of the array that matches its window (empty where none does)."""
    n = len(test)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order), np.int64)
    longest, first, last = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive, depth = np.arange(n), 0
    padded = np.append(ids, -1)
    while len(alive):
        alive = alive[alive + depth < ends[alive]]
        if not len(alive):
            break
        column = padded[np.minimum(order + depth, len(ids))]
        want = test[alive + depth]
        a = _edge(column, lo[alive], hi[alive], want, right=False)
        b = _edge(column, a, hi[alive], want, right=True)
        some = b > a
        alive, a, b = alive[some], a[some], b[some]
        lo[alive], hi[alive] = a, b
        depth += 1
        longest[alive] = depth
        whole = need[alive] == depth
        first[alive[whole]], last[alive[whole]] = a[whole], b[whole]
    return longest, first, last


def _expand(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) for every place in every query's range."""
    counts = last - first
    query = np.repeat(np.arange(len(first)), counts)
    return query, np.arange(len(query)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)


def shard_hits(texts: pa.Array, items: Items) -> dict[str, list]:
    """The hits of each text of one shard."""
    w = W.words(texts, W.LETTERS_DIGITS)
    docs = len(w.first) - 1
    n = len(w.hash)
    out = {"n_words": np.diff(w.first), "n_hit": np.zeros(docs, np.int64), "longest": np.zeros(docs, np.int64), "items": [None] * docs,
           "starts": [None] * docs, "ends": [None] * docs}
    if not n or not len(items.heads):
        return out
    # a match of a window starts with the first words of some window: no other suffix need be sorted
    if items.shortest > 1:
        at = np.flatnonzero(w.doc[1:] == w.doc[:-1]) if n > 1 else np.empty(0, np.int64)
        at = at[np.isin(_pairs(w.hash, w.hash[1:], at), items.heads)]
    else:
        at = np.flatnonzero(np.isin(w.hash, items.heads))
    if not len(at):
        return out
    # each text ends with 0, a word of no item
    place = np.arange(n) + w.doc
    vocabulary = np.unique(items.hash)
    known = np.minimum(np.searchsorted(vocabulary, w.hash), len(vocabulary) - 1)
    ids = np.zeros(n + docs, np.int64)
    ids[place] = np.where(vocabulary[known] == w.hash, known + 2, 1)  # 1: a word of no item, equal to none of theirs
    test = np.searchsorted(vocabulary, items.hash) + 2
    order = suffix_order(ids, place[at], int((items.ends - np.arange(len(test))).max()))
    longest, first, last = search(ids, order, test, items.ends, items.need)
    window, row = _expand(first, last)
    if not len(window):
        return out
    doc_of = np.zeros(n + docs, np.int64)
    doc_of[place] = w.doc
    begin = order[row]
    doc, begin = doc_of[begin], begin - doc_of[begin]
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + items.need[window], -1)
    hit = np.cumsum(change[:-1]) > 0
    out["n_hit"] = np.bincount(w.doc[hit], minlength=docs)
    np.maximum.at(out["longest"], doc, longest[window])
    edges = np.flatnonzero(hit & ~(np.r_[False, hit[:-1]] & np.r_[False, w.doc[1:] == w.doc[:-1]]))
    stops = np.flatnonzero(hit & ~(np.r_[hit[1:], False] & np.r_[w.doc[1:] == w.doc[:-1], False])) + 1
    run_doc = w.doc[edges]
    item = items.item[window]
    pairs = np.unique(doc * len(items.ids) + item)
    pair_doc, pair_item = pairs // len(items.ids), pairs % len(items.ids)
    for d in np.unique(doc):
        own = slice(*np.searchsorted(pair_doc, [d, d + 1]))
        runs = slice(*np.searchsorted(run_doc, [d, d + 1]))
        out["items"][d] = sorted({i for i in items.ids[pair_item[own]] if i is not None})
        out["starts"][d] = (edges[runs] - w.first[d]).tolist()
        out["ends"][d] = (stops[runs] - w.first[d]).tolist()
    return out


def _merged(a: dict, b: dict, i: int) -> None:
    """Adds the hits of an earlier block to those of row i."""
    if not a or not a["starts"]:
        return
    runs = sorted([*zip(a["starts"], a["ends"]), *zip(b["starts"][i] or [], b["ends"][i] or [])])
    starts, ends = [], []
    for s, e in runs:
        if starts and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    b["starts"][i], b["ends"][i] = starts, ends
    b["items"][i] = sorted({*(a["items"] or []), *(b["items"][i] or [])})
    b["n_hit"][i] = sum(ends) - sum(starts)
    b["longest"][i] = max(a["longest"], b["longest"][i])


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[pd.DataFrame]:
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    n = max(1, math.ceil((total(rows, F.sum(F.octet_length("text")).alias("n"))["n"] or 0) / block_bytes))
    for k in range(n):
        yield (rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).toPandas()


def with_hits(docs: DataFrame, benchmark: DataFrame, name: str, text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows with the struct `name` (see HITS): where windows of `window` consecutive words of the items occur. An item
    of fewer words, but not none, is one window. Items without words or text match nothing; an item without an id marks
    words but is not listed. Lists are NULL where nothing was found."""
    out = docs
    for k, block in enumerate(_blocks(benchmark, block_bytes)):
        items = Items(block["item_id"].tolist(), block["text"].tolist(), window)
        more = k > 0

        def scan(batches: Iterator[pa.RecordBatch], items=items, more=more) -> Iterator[pa.RecordBatch]:
            for batch in W.chunks(batches, text):
                found = shard_hits(batch.column(text), items)
                if more:
                    for i, earlier in enumerate(batch.column(name).to_pylist()):
                        _merged(earlier, found, i)
                columns = [pa.array(found[f.name], f.type) for f in _ARROW]
                struct = pa.StructArray.from_arrays(columns, fields=list(_ARROW))
                names = [c for c in batch.schema.names if c != name]
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [struct], names + [name])

        schema = T.StructType([*docs.schema.fields, T.StructField(name, HITS)])
        out = out.mapInArrow(scan, schema)
    return out


def remove_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents in which no benchmark window occurs."""
    name = free_name(docs, "hits")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return with_hits(docs, benchmark, name).filter(F.col(name)["n_hit"] == 0).select(*docs.columns)


# Words, windows of the items, and the words of documents inside an occurrence
HITS_SQL = r"""
dw AS (SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
       FROM (SELECT row_number() OVER () AS r, * FROM {docs})),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS k
        FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM iw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dk AS (SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS k FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, lens)),
occ AS (SELECT r, item_id, dk.n, i FROM dk JOIN win ON dk.n = win.n AND dk.k = win.k),
hitw AS (SELECT r, count(DISTINCT i + o) AS n_hit FROM (SELECT r, i, unnest(range(n)) AS o FROM occ) GROUP BY r),
hiti AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM occ GROUP BY r)
"""


@query(
    "op9_decontamination",
    "WITH " + HITS_SQL.format(docs="documents") + """
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hitw USING (r) LEFT JOIN hiti USING (r)""",
)
def op9_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = with_hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "hits")
    items = F.coalesce(F.col("hits.items"), F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "hits.n_words", "hits.n_hit", F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (F.col("hits.n_hit") > 0).alias("contaminated"),
    )
