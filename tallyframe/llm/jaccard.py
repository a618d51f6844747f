"""Near-duplicate join of documents on their sets of word shingles, by prefixes of single tokens and token combinations.

A document's tokens are the 64-bit hashes of its distinct shingles; documents with one set are one class. Let a set have n
tokens. A partner needs an overlap of t = ceil(n * threshold) at least, so with any order of all tokens both share k tokens
among their first n - t + k (the prefix, extended by k - 1).

1. Extended prefixes in hash order, sent as packed bytes by range of hashes, tell which sets can have k of their first
   tokens in other sets. Most documents end here.
2. The rest count their tokens exactly. In the order of frequency the first shared token of two sets lies in both plain
   prefixes. If it is rare it is indexed alone. If it is frequent all shared tokens are, and both share k tokens of their
   prefixes extended by k - 1: frequent tokens fall into k - 1 classes by hash, so some class holds two shared ones, and
   pairs of tokens of a class are indexed. k grows with the set, so that a set has about as many pairs as tokens.
3. In each list of the index every set meets the most common one, its head, which is linear also in groups of thousands;
   verified links give components. Then sets of different components that met one head are compared, where the tokens they
   have beside the head's allow a link. Nothing is capped: two sets that are never compared are in one component or cannot
   be linked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm import words as W
from tallyframe.llm.common import free_name, total, written
from tallyframe.llm.components import components
from tallyframe.llm.registry import query

SHINGLE = 5
PERCENT = 75  # 100 * intersection >= PERCENT * union
FREQUENT = 32  # sets in a list from which a token is indexed in pairs
TOKENS_A_RANGE = 1 << 21  # extended-prefix tokens looked at by one task


def token_sets(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, first): the sorted distinct tokens of each text one after the other, and where each text's begin."""
    value, doc = W.shingles(W.words(texts, W.BLANK_SEPARATED), size)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[new], doc[new]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def set_keys(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set (0 for an empty one)."""
    sums = np.append(np.uint64(0), np.cumsum(W.mixed(tokens ^ np.uint64(0x5851F42D4C957F2D))))
    n = np.diff(first).astype(np.uint64)
    return np.where(n > 0, W.mixed(sums[first[1:]] - sums[first[:-1]] + n), np.uint64(0)).view(np.int64)


def _need(n):
    """The smallest overlap with any partner."""
    return -(-n * PERCENT // 100)


def _shared_of_first(n):
    """k: of the first n - t + k tokens a set with a partner shares k; about half of the plain prefix."""
    return np.minimum((n - _need(n) + 2) // 2, _need(n))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---- 1: which sets can have a partner ------------------------------------------------------------------------------

PACKED = "doc_id long, set_key long, n long, `range` int, tokens binary, counts binary, sets binary"


def _pack(ranges: int, text: str, row: str):
    """One row per document, and for each range of hashes the extended prefixes' tokens in it: their low 4 bytes, how many
    each set has, and the sets' names. A set met before in the same task is not sent again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in W.chunks(batches, text):
            tokens, first = token_sets(batch.column(text))
            keys, n = set_keys(tokens, first), np.diff(first)
            new = np.zeros(len(n), bool)
            for i, k in enumerate(keys.tolist()):
                if k and k not in seen:
                    seen.add(k)
                    new[i] = True
            short = n - _need(n) + 1
            take = np.where(new, short - 1 + _shared_of_first(n), 0)  # in hash order: the sets are sorted
            at = np.repeat(first[:-1] - np.cumsum(take) + take, take) + np.arange(int(take.sum()))
            doc, value = np.repeat(np.arange(len(n)), take), tokens[at]
            part = (((value >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            doc, value, part = doc[order], value[order], part[order]
            edges = np.searchsorted(part, np.arange(ranges + 1))
            rows = {"range": [], "tokens": [], "counts": [], "sets": []}
            for r in np.flatnonzero(np.diff(edges)).tolist():
                own = slice(edges[r], edges[r + 1])
                docs, counts = np.unique(doc[own], return_counts=True)
                rows["range"].append(r)
                rows["tokens"].append((value[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
                rows["counts"].append(counts.astype(np.uint32).tobytes())
                rows["sets"].append(keys[docs].tobytes())
            m, d = len(rows["range"]), len(n)
            none = lambda size, kind: pa.nulls(size, kind)
            columns = [
                pa.concat_arrays([batch.column(row).cast(pa.int64()), none(m, pa.int64())]),
                pa.concat_arrays([pa.array(keys, pa.int64()), none(m, pa.int64())]),
                pa.concat_arrays([pa.array(n, pa.int64()), none(m, pa.int64())]),
                pa.concat_arrays([none(d, pa.int32()), pa.array(rows["range"], pa.int32())]),
                *[pa.concat_arrays([none(d, pa.binary()), pa.array(rows[c], pa.binary())]) for c in ("tokens", "counts", "sets")],
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "set_key", "n", "range", "tokens", "counts", "sets"])

    return run


def _repeated(group: pd.DataFrame) -> pd.DataFrame:
    """(set_key, excess) of the sets with more than a third of their tokens in this range in other sets too: three times
    those, less all. A set with a partner shares k of its K first tokens, so its excesses add up to 3 k - K, which is
    positive, and those of the other ranges only lessen the sum. Equal low bytes in one range are taken as equal tokens:
    that can only let a set pass."""
    tokens = np.concatenate([np.frombuffer(x, np.uint32) for x in group["tokens"]])
    counts = np.concatenate([np.frombuffer(x, np.uint32) for x in group["counts"]]).astype(np.int64)
    sets = np.concatenate([np.frombuffer(x, np.int64) for x in group["sets"]])
    first = np.zeros(len(sets), bool)
    first[np.unique(sets, return_index=True)[1]] = True  # other tasks may have sent the same set
    tokens, sets, counts = tokens[np.repeat(first, counts)], sets[first], counts[first]
    order = np.argsort(tokens, kind="stable")
    same = np.diff(tokens[order].astype(np.int64)) == 0
    shared = np.zeros(len(tokens), bool)
    shared[order[1:]] |= same
    shared[order[:-1]] |= same
    hits = np.add.reduceat(shared, np.cumsum(counts) - counts, dtype=np.int64)
    excess = 3 * hits - counts
    some = excess > 0
    return pd.DataFrame({"set_key": sets[some], "excess": excess[some]})


def classes_and_candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((doc_id, set_key, n) of every document, (set_key, n, doc_id) of the sets that can have a partner, with one document
    of each). The number of ranges follows the input's size: one task sees about TOKENS_A_RANGE tokens."""
    size = total(docs, F.sum(F.octet_length("text")).alias("n"))["n"] or 0
    ranges = max(1, math.ceil(size / 16 / TOKENS_A_RANGE))
    packed = written(docs.mapInArrow(_pack(ranges, "text", "doc_id"), PACKED), "packed")
    rows = packed.filter(F.col("range").isNull()).select("doc_id", "set_key", "n")
    blobs = packed.filter(F.col("range").isNotNull()).select("range", "tokens", "counts", "sets")
    found = blobs.groupBy("range").applyInPandas(_repeated, "set_key long, excess long").groupBy("set_key").agg(F.sum("excess").alias("excess"))
    names = rows.groupBy("set_key").agg(F.first("n").alias("n"), F.min("doc_id").alias("doc_id"))
    need = F.ceil(F.col("n") * PERCENT / 100)
    short = F.col("n") - need + 1
    shared = F.least(F.floor((short + 1) / 2), need)
    enough = F.col("excess") >= 3 * shared - (short - 1 + shared)
    return rows, found.join(names, "set_key").filter(enough).select("set_key", "n", "doc_id")


# ---- 2: the index --------------------------------------------------------------------------------------------------


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in W.chunks(batches, "text"):
        tokens, first = token_sets(batch.column("text"))
        keys = np.repeat(set_keys(tokens, first), np.diff(first))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(_signed(tokens))], ["set_key", "token"])


def counted_sets(docs: DataFrame, able: DataFrame) -> DataFrame:
    """(set_key, n, tokens): the sets that may have a partner, with the (count, token) of their tokens that several of them
    have, rarest first. A set most of whose tokens no other set has is left out."""
    # repeated ids may bring texts beyond those asked for, or one set twice: more to count, the same links in the end
    # both sides grow with the input: merged, never broadcast
    wanted = able.select("doc_id").filter("doc_id IS NOT NULL").distinct().hint("merge")
    texts = docs.join(wanted, "doc_id").select("text")
    texts = texts.unionByName(docs.filter("doc_id IS NULL").select("text"))
    tokens = written(texts.mapInArrow(_tokens, "set_key long, token long"), "tokens")
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("count")).filter("count > 1")
    sets = (
        tokens.join(often, "token").groupBy("set_key").agg(F.collect_set(F.struct("count", "token")).alias("tokens"))
        .join(able.select("set_key", "n"), "set_key")
    )
    return sets.filter((F.col("n") > 2) & (F.size("tokens") * 100 >= F.col("n") * PERCENT)).withColumn("tokens", F.sort_array("tokens"))


def _short(n: Column) -> Column:
    """Length of the plain prefix of a set of n tokens."""
    return (n - F.ceil(n * PERCENT / 100) + 1).cast("int")


def _classes(n: Column) -> Column:
    """Classes of frequent tokens for a set of n: a power of two near the plain prefix; one where that is short."""
    return F.when(_short(n) < 8, 1).otherwise(F.pow(F.lit(2), F.floor(F.log2(_short(n))))).cast("int")


def index_lists(sets: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """(list, set_key, n, stored, rarity): a list for each rare token of a plain prefix, and for each two frequent tokens of
    one class in an extended prefix. Tokens that no other set has come first in the order and only shorten the prefix of the
    stored ones. rarity is the share of a set's tokens that are not frequent."""
    n, own = F.col("n"), ["set_key", "n", "stored", "rarity"]
    often = F.size(F.filter("tokens", lambda t: t["count"] > frequent))
    rows = sets.withColumn("stored", F.size("tokens")).withColumn("rarity", (n - often) / n)
    rows = rows.withColumn("left", _short(n) - (n.cast("int") - F.col("stored"))).filter("left > 0")
    plain = F.slice("tokens", F.lit(1), F.col("left"))
    rare = rows.select(*own, F.explode(F.filter(plain, lambda t: t["count"] <= frequent)).alias("t"))
    rare = rare.select(F.xxhash64(F.lit(0), "t.token").alias("list"), *own)
    # partners may belong to the next size: both sides use the classes of either
    choices = F.array_distinct(F.array(_classes(F.ceil(n * PERCENT / 100)), _classes(n), _classes(F.floor(n * 100 / PERCENT))))
    dominated = rows.filter(F.exists(plain, lambda t: t["count"] > frequent))
    dealt = dominated.select(*own, "tokens", "left", F.explode(choices).alias("classes"))
    extended = F.slice("tokens", F.lit(1), F.col("left") + F.col("classes"))
    tokens = dealt.select(
        *own, "classes", F.explode(F.filter(extended, lambda t: t["count"] > frequent)).alias("t")
    ).select(*own, "classes", F.col("t.token").alias("token"), F.pmod(F.xxhash64("t.token"), F.col("classes")).alias("class"))
    together = tokens.groupBy(*own, "classes", "class").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    pairs = together.select(*own, "classes", "tokens", F.posexplode("tokens").alias("i", "one")).select(
        *own, "classes", "one", F.explode(F.expr("slice(tokens, i + 2, size(tokens))")).alias("other")
    )
    return rare.unionByName(pairs.select(F.xxhash64("classes", "one", "other").alias("list"), *own))


# ---- 3: links ------------------------------------------------------------------------------------------------------


def _enough(common: Column, na: Column, nb: Column) -> Column:
    return common * (100 + PERCENT) >= (na + nb) * PERCENT


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) with the sizes of their sets and of the intersection, and b's other tokens, rarest first."""
    own = sets.select("set_key", "n", F.col("tokens.token").alias("tokens"))
    left = own.select(F.col("set_key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = own.select(F.col("set_key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("rest", F.array_except("tb", "ta"))
    return both.select("a", "b", "na", "nb", (F.size("tb") - F.size("rest")).alias("common"), "rest")


def _across(rows: DataFrame, keys: list[str], also: Column) -> DataFrame:
    """Pairs of sets of different components among rows with equal keys, if the bound on their overlap allows a link."""
    sizes = rows.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("k")).groupBy(*keys)
    mixed = sizes.agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    rows = rows.join(mixed.drop("labels"), keys)
    # of two components one is not the main one
    side = lambda x: [F.col(c).alias(c + x) for c in ("set_key", "label", "n", "o", "r")]
    few, all_ = rows.filter("label != main").select(*keys, *side("1")), rows.select(*keys, "main", *side("2"))
    most = F.least("o1", "o2") + F.least("r1", "r2")
    met = few.join(all_, keys).filter(
        (F.col("label1") != F.col("label2")) & ((F.col("label2") == F.col("main")) | (F.col("label1") < F.col("label2")))
        & (F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * PERCENT) & _enough(most, F.col("n1"), F.col("n2")) & also
    )
    return met.select(F.least("set_key1", "set_key2").alias("a"), F.greatest("set_key1", "set_key2").alias("b"))


def set_components(sets: DataFrame, lists: DataFrame) -> DataFrame:
    """(node, label) of every set that has a link.

    The head of a list is its most common set: of near-copies the one most like the others. Every set of the list meets it.
    Let o be a set's overlap with the head and r its other tokens that several sets have. Two sets of the list share
    min(o, o') + min(r, r') tokens at most; if min(o, o') is not enough for a link, they share some of their other tokens,
    and one of the first r - (need - o) + 1 in particular. So sets of different components meet at such a token, or where
    both have enough in common with the head: few do, however many have the head.
    """
    lists = written(lists, "lists")
    heads = lists.groupBy("list").agg(F.min_by("set_key", F.struct("rarity", "set_key")).alias("head"), F.count(F.lit(1)).alias("sets"))
    met = lists.join(heads.filter("sets > 1"), "list").filter("set_key != head").select(F.col("head").alias("a"), F.col("set_key").alias("b")).distinct()
    n, r = F.col("nb").cast("int"), F.size("rest")
    first = r - F.greatest(F.lit(1), F.ceil(n * PERCENT / 100).cast("int") - F.col("common")) + 1
    met = overlaps(written(met, "met"), sets).withColumn("first", F.slice("rest", F.lit(1), F.greatest(F.lit(0), first)))
    met = written(met.withColumn("r", r).drop("rest"), "overlaps")
    links = met.filter(_enough(F.col("common"), F.col("na"), F.col("nb"))).select("a", "b")
    labels = components(links)

    rows = met.select(F.col("a").alias("head"), F.col("b").alias("set_key"), F.col("nb").alias("n"), F.col("common").alias("o"), "r", "first")
    rows = rows.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    tokens = rows.select("head", "set_key", "label", "n", "o", "r", F.explode("first").alias("token"))
    by_token = _across(tokens, ["head", "token"], F.lit(True))
    close = rows.filter(F.col("o") * 100 >= F.col("n") * PERCENT)
    by_head = _across(close, ["head"], _enough(F.least("o1", "o2"), F.col("n1"), F.col("n2")))
    done = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = by_token.unionByName(by_head).distinct().join(done, ["a", "b"], "left_anti")
    more = overlaps(written(pairs, "across"), sets)
    more = written(more.filter(_enough(F.col("common"), F.col("na"), F.col("nb"))).select("a", "b"), "links")
    if more.isEmpty():
        return labels
    return components(links.unionByName(more))


def near_classes(docs: DataFrame, text: str = "text", row: str = "doc_id") -> DataFrame:
    """(doc_id, set_key, n, label, component_id) of every row: its set's name and size, the name of a set that stands for its
    component, and the smallest id reachable by links.

    Words are folded A-Z and separated by blanks; a text of fewer words than a shingle is one token; a text without words
    (also NULL) has no token and is linked with nothing. Rows stay as they are, repeated ids included; a NULL id is
    nobody's component id unless no row of the component has one.
    """
    docs = docs.select(F.col(row).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows, able = classes_and_candidates(docs)
    able = written(able, "able")
    sets = written(counted_sets(docs, able), "sets")
    labels = set_components(sets, index_lists(sets))
    named = rows.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").withColumn("label", F.coalesce("label", "set_key"))
    ids = named.filter("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return named.join(ids, "label", "left").select(
        "doc_id", "set_key", "n", "label", F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id")
    )


def one_of_each(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near-duplicates the document with the smallest id, a NULL one only where no other is.
    Groups are told apart by their sets, never by ids: different texts of one id, or without one, all stay. Texts without
    words all stay; rows with one id and one set of tokens are one document."""
    name, chosen, apart = free_name(docs, "set_key"), free_name(docs, "chosen"), free_name(docs, "apart")
    found = near_classes(docs)
    least = F.min_by(F.struct("doc_id", "set_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "set_key"))
    kept = found.filter("n > 0").groupBy("label").agg(least.alias(chosen)).select(chosen)
    bare = found.filter("n = 0").select(F.struct("doc_id", "set_key").alias(chosen)).distinct()
    kept = written(kept.unionByName(bare), "kept")
    first = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.chunks(batches, "text"):
            keys = set_keys(*token_sets(batch.column("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], [*batch.schema.names, name])

    rows = docs.mapInArrow(keyed, first)
    single = rows.join(kept, rows["doc_id"].eqNullSafe(F.col(f"{chosen}.doc_id")) & (rows[name] == F.col(f"{chosen}.set_key")), "left_semi")
    # without an id and without words nothing tells that two rows are one
    single = single.withColumn(apart, F.when(F.col("doc_id").isNull() & (F.col(name) == 0), F.monotonically_increasing_id()))
    return single.dropDuplicates(["doc_id", name, apart]).select(*docs.columns)


NEAR_SQL = r"""
sw AS (SELECT r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
       FROM (SELECT row_number() OVER () AS r, doc_id, text FROM {docs})),
sh AS (SELECT DISTINCT r, array_to_string(ws[i : i + 4], ' ') AS k FROM (SELECT r, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM sw WHERE len(ws) > 0)),
ns AS (SELECT r, count(*) AS n FROM sh GROUP BY r),
ov AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.r < b.r GROUP BY 1, 2),
lk AS (SELECT a, b FROM ov JOIN ns x ON x.r = a JOIN ns y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
ed AS (SELECT a, b FROM lk UNION ALL SELECT b, a FROM lk),
reach AS (WITH RECURSIVE w(a, b) AS (SELECT a, b FROM ed UNION SELECT w.a, ed.b FROM w JOIN ed ON w.b = ed.a) SELECT a, min(doc_id) AS least FROM w JOIN sw ON sw.r = w.b GROUP BY a),
near AS (SELECT sw.r, doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, least) AS component_id FROM sw LEFT JOIN ns USING (r) LEFT JOIN reach ON reach.a = sw.r)
"""


@query("op8_jaccard_join", "WITH " + NEAR_SQL.format(docs="documents") + "SELECT doc_id, n_shingles, component_id FROM near")
def op8_jaccard_join(spark, sf_dir):
    found = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")
