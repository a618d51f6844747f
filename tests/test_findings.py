"""Faults that a review found, each on rows small enough to read."""

from __future__ import annotations

import pathlib
import random
import re
import tracemalloc
import unicodedata
from datetime import date

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import check_queries
from tallyframe.functions import text as X
from tallyframe.operators import collection as CO
from tallyframe.operators import documents as D
from tallyframe.operators import imports as IM
from tallyframe.plans.checks import LEDGER
from tallyframe.plans.domain import Domain
from tallyframe.sources import pages as PG
from tallyframe.storage import fresh_folder
from tallyframe.tables import Ledger


def against_sql(spark, folder, name, **tables):
    """Rows of a query and of its SQL over the tables given as (schema, rows)."""
    con = duckdb.connect()
    for table, (schema, rows_) in tables.items():
        spark.createDataFrame(rows_, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    df = entry_points.queries()[name](spark, str(folder))
    cur = con.execute(entry_points.oracle_sql()[name])
    return check_queries.rows(df.columns, df.collect()), check_queries.rows([c[0] for c in cur.description], cur.fetchall())


# 3 is listed as seen; 4 and 5 list its address again, elsewhere.
REPEATED = [
    (i, url, f"<html><title>T{i}</title><p>{text}</p></html>")
    for i, url, text in ((1, "http://a.it/x", "That one"), (3, "http://a.it/y", "nobody"), (4, "http://a.it/y#top", "Anon speaks"),
                         (5, "http://a.it/y?utm_source=feed", "nobody at all"), (6, "http://m.b.it/z", "With the rest"))
]
PAGES = "page_id bigint, url string, html string"


@pytest.mark.parametrize("name", ["collect_documents", "pass_summary", "run_health"])
def test_an_address_seen_in_one_place_is_judged_in_another(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, pages=(PAGES, REPEATED))
    assert got == want


# Page numbers on several rows, with the same and with another address; no address, no number; pages without a text.
SAME_PLACES = [
    *[(6, "http://a.it/x", "<p>twice the same row</p>")] * 3, (12, "http://b.it/x", "<p>one</p>"), (12, "http://b.it/y", "<p>two</p>"),
    (12, "http://b.it/z", "<p>two</p>"), (3, "http://c.it/x", "<p>seen</p>"), (3, "http://c.it/x", "<p>seen</p>"), (15, "http://c.it/x", "<p>seen</p>"),
    (18, None, "<p>three</p>"), (21, None, "<p>four</p>"), (27, None, "<p>five</p>"), (None, "http://d.it/x", "<p>Anon</p>"), (None, "http://d.it/y", "<p>nobody</p>"),
    (30, "http://m.e.it/x", "<p></p>"), (33, "http://m.e.it/y", "<br>"), (36, "http://m.e.it/z", ""), (40, "http://m.e.it/c", ""),
]


@pytest.mark.parametrize("name", ["pass_summary", "run_health"])
def test_elements_in_one_place_are_counted_one_by_one(spark, tmp_path, name):
    got, want = against_sql(spark, tmp_path, name, pages=(PAGES, SAME_PLACES))
    assert got == want


# Hosts with capitals, a port, a user; a text also found without a source; spaces and tabs that only some call blank.
SOURCES = [
    (6, "http://A.it/x", "<p>one</p>"), (9, "http://a.it/y", "<p>two</p>"), (12, "http://a.it:80/z", "<p>three</p>"), (15, "http://u@a.it/w", "<p>four</p>"),
    (18, None, "<p>five</p>"), (21, "http://z.it/x", "<p>five</p>"), (30, "http://b.it/x", "six"), (33, "http://b.it/y", "<p>\u00a0six\u3000</p>"),
    (36, "http://b.it/z", "six\x0bsix"), (39, "http://b.it/w", "six six"), (None, "http://z.it/y", "seven"), (42, "http://z.it/z", "seven"),
]


def test_elements_are_counted_under_the_source_as_written(spark, tmp_path):
    got, want = against_sql(spark, tmp_path, "run_health", pages=(PAGES, SOURCES))
    assert got == want and len(got) == 7


def test_an_element_gives_one_row_wherever_it_stands(spark):
    listed = "source string, level string, channel string, ord int, url string, title string, summary string, text string, published_at timestamp, reserved boolean"
    made = [(s, "A", "site", o, u, "T", None, t, None, None) for s, o, u, t in (
        ("s", 1, "https://s/1", "x"), ("s", 1, "https://s/1", "x"), ("s", 1, "https://s/2", "y"), (None, 1, "https://s/3", "z"), ("s", None, "https://s/4", "w"), ("s", 2, "https://s/5", ""), ("s", 3, "https://s/6", ""))]
    made.append(("s", "C", "site", 4, "https://s/7", "Rossi", None, "kept where nothing is reserved", None, None))
    judged = CO.judge_documents(spark.createDataFrame(made, listed), spark.createDataFrame([], "url string"), CO.Names({"r": ["Rossi"]}), F.current_timestamp())
    assert sorted((r.url[-1], r.outcome, r.text) for r in judged.collect() if r.outcome == "stored") == [
        ("1", "stored", "x"), ("2", "stored", "y"), ("3", "stored", "z"), ("4", "stored", "w"), ("5", "stored", None), ("6", "stored", None), ("7", "stored", "kept where nothing is reserved")]
    assert judged.count() == len(made)


def test_shared_text_writes_less_than_it_reads(spark, monkeypatch):
    rnd = random.Random(5)
    base = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(200))
    texts = [base + f" {i}" for i in range(3)] + [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(400)) for _ in range(60)]
    df = spark.createDataFrame([(i, f"p{i % 4}", t) for i, t in enumerate(texts)], "document_id int, party_id string, text string")
    folders = []
    monkeypatch.setattr(D, "written", lambda rows, name: folders.append(fresh_folder(spark, name)) or rows.write.parquet(folders[-1]) or spark.read.schema(rows.schema).parquet(folders[-1]))
    found = sorted(map(tuple, D.shared_text(df).collect()))
    assert found == [(a, f"p{a}", f"p{b}") for a in range(3) for b in range(3) if a != b]
    data = sum(f.stat().st_size for folder in folders for f in pathlib.Path(folder).glob("*.parquet"))
    assert data < 0.25 * sum(map(len, texts))


def test_what_checks_of_a_release_share_is_written_once(spark):
    df = entry_points.queries()["release_violations"](spark, "/root/testdata/sf0.001")
    read = {f.rsplit("/", 1)[1] for f in df.inputFiles() if f.startswith("file:///root/testdata/")}
    assert read == {"events.parquet"}  # for the corrections, which one check reads


def test_ballot_days_are_taken_from_the_lines_once(spark):
    d = Domain(spark, "/root/testdata/sf0.001")
    assert not [f for v in ("ballot_facts", "statements", "anchors") for f in d.shared(v).inputFiles() if "/lineitem.parquet" in f]
    assert sorted(d.shared("ballot_days").collect()) == sorted(d.table("lineitem").selectExpr("CAST(date_trunc('week', l_shipdate) AS date) AS ballot_id").distinct().collect())


def test_votes_of_some_people_are_theirs_among_all(spark):
    d = Domain(spark, "/root/testdata/sf0.001")
    some = d.shared("persons").filter("person_id % 11 = 0").select("person_id")
    theirs = d.votes_of(some).select(*d.votes.columns)
    want = d.votes.join(some, "person_id", "left_semi").select(*d.votes.columns)
    assert theirs.count() > 0 and sorted(map(str, theirs.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", ["balanced_selection", "full_report"])
def test_votes_are_counted_once(spark, name):
    df = entry_points.queries()[name](spark, "/root/testdata/sf0.001")
    assert not [f for f in df.inputFiles() if "/orders.parquet" in f]  # only what counts votes reads orders


def test_a_stored_block_is_not_imported_again(spark):
    ballots = spark.createDataFrame([(1, "lower", 19, "v1", 1, 0, 0)], "ballot_id int, chamber string, term int, ext_id string, n_for long, n_against long, n_abstain long")
    votes = spark.createDataFrame([(1, 7, 3, "for", date(2024, 1, 1))], "ballot_id int, person_id long, group_id int, expression string, on_date date")
    memberships = spark.createDataFrame([], "person_id long, kind string, group_id int, party_id int, valid_from date, valid_to date")
    persons = spark.createDataFrame([(7, "person-7")], "person_id long, slug string")
    group_party = spark.createDataFrame([(3, 1, date(2020, 1, 1), None)], "group_id int, party_id int, valid_from date, valid_to date")
    schemas = {n: s.replace("ballot_id date", "ballot_id int") for n, s in LEDGER.items()}
    ledger = Ledger(spark, fresh_folder(spark, "ledger"), schemas)
    assert IM.import_block(ledger, "19", ballots, votes, memberships, persons, group_party)
    assert IM.import_block(ledger, "again", ballots, votes, memberships, persons, group_party) is None
    assert {n: ledger.read(n).count() for n in schemas} == {"ballots": 1, "counts": 1, "kept": 1, "unattributed": 0}
    assert [r.block for r in ledger.commits().collect()] == ["19"] and ledger.read("ballots").first().coherent


def peak(work):
    """The most memory that the work's Python objects and numpy arrays take, and what it returns."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_batch_of_words_is_summed_in_pieces():
    rnd = np.random.default_rng(3)
    sizes = rnd.integers(0, 1000, 4000)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(rnd.integers(0, 50, sizes.sum())))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), lists], ["doc_id", "w"])
    run = D._measured(np.arange(40), 20, "w")
    rows, most = peak(lambda: [r for b in run(iter([batch])) for r in b.to_pylist()])
    assert [r["doc_id"] for r in rows] == list(range(4000))
    for r in rows[:300]:
        hit = [x < 40 for x in lists[r["doc_id"]].as_py()]
        worst = min((sum(hit[i : i + 20]) for i in range(len(hit) - 19)), default=sum(hit))
        assert (r["words"], r["known"], r["worst"]) == (len(hit), sum(hit), worst)
    assert most < 24e6  # the two million words of the batch take 16e6 alone


def test_pages_are_read_a_few_at_a_time():
    html = pa.array(["<html><title>T</title><body><p>" + "parola " * 3000 + "</p></body></html>"] * 1000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), html, pa.array([False] * 1000)], ["page_id", "html", "reserved"])
    read, most = peak(lambda: sum(b.num_rows for b in PG._read_pages(iter([batch]))))
    assert read == 1000 and most < 12e6  # the pages take 21e6


def quote_form(quote: str) -> str:
    """The normal form of a quotation, rule by rule."""
    for pattern in (r"^\s+|\s+$", "^[\"'«»“”‘’]+|[\"'«»“”‘’]+$", r"^\s+|\s+$"):
        quote = re.sub(pattern, "", quote)
    t = unicodedata.normalize("NFKC", quote)
    t = t.translate({ord(c): to for signs, to in ((X.DASHES, "-"), (X.APOSTROPHES, "'"), (X.QUOTES, '"'), ("\u00ad", None)) for c in signs})
    for pattern, to in ((r"\s*-\s*", "-"), (r"\s+([,.;:!?)\]])", r"\1"), (r"([(\[])\s+", r"\1"), (r"\s+", " ")):
        t = re.sub(pattern, to, t)
    return t.strip(" ").lower().replace("ß", "ss").replace("ς", "σ")


def test_quotations_are_folded_without_looking_for_what_is_not_there(spark):
    rnd = random.Random(9)
    signs = [*"abE --,.;)]([\"'`\n\t\r$", *X.BLANKS, *X.DASHES, *X.APOSTROPHES, *X.QUOTES, *"\u00ad\u200bßςéﬁ①½Á"]
    texts = ["".join(rnd.choice(signs[:: 1 + 2 * (i % 2)]) for _ in range(rnd.randrange(14))) for i in range(4000)]
    given = spark.createDataFrame([(t,) for t in texts], "t string")
    form = given.select("t", X.quote_form(X.bare_quote(F.col("t"))).alias("form"))
    assert [(r["t"], r["form"]) for r in form.collect()] == [(t, quote_form(t)) for t in texts]
    # quotation marks and blanks are taken off without a pattern, and a plain text is not searched for what NFKC changes
    assert "regexp" not in str(X.bare_quote(F.col("t"))).lower()
    assert "octet_length" in str(X.nfkc(F.col("t")))
