"""Queries on landed source rows: the given tables shaped as sources deliver them, read back by the source operators."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tallyframe.functions import text as X
from tallyframe.operators import quality as Q
from tallyframe.plans.registry import query
from tallyframe.sources import bindings as B
from tallyframe.sources import chambers as CH
from tallyframe.sources import feeds as FE
from tallyframe.sources import registry as RG


def text(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def as_map(**columns):
    return F.map_from_arrays(F.array(*[F.lit(k) for k in columns]), F.array(*columns.values())).alias("row")


@query("binding_rows", """
    SELECT o_orderkey, 'http://x/' || o_orderkey::varchar AS v, o_custkey::varchar AS n FROM orders
    UNION ALL SELECT o_orderkey, 'http://y/' || o_orderkey::varchar, NULL FROM orders""")
def binding_rows(d):
    """Each order as an answer of two bindings, the second without the optional variable."""
    key = F.col("o_orderkey")
    body = text(
        '{"results":{"bindings":[{"v":{"type":"uri","value":"http://x/', key, '"},"n":{"type":"literal","value":"', F.col("o_custkey"),
        '"}},{"v":{"type":"uri","value":"http://y/', key, '"}}]}}',
    )
    rows = d.table("orders").select(key, F.explode(B.bindings_of(body)).alias("_b"))
    value = lambda k: F.try_element_at("_b", F.lit(k))["value"]
    return rows.select("o_orderkey", value("v").alias("v"), value("n").alias("n"))


@query("lower_vote_rows", """
    SELECT 'vs19_' || l_orderkey::varchar AS ballot_ext_id, l_suppkey::varchar AS person_ext_id,
           CASE l_returnflag WHEN 'R' THEN 'for' WHEN 'A' THEN 'against' ELSE CASE l_linenumber % 3 WHEN 0 THEN 'on_mission' WHEN 1 THEN 'not_voting' ELSE 'absent' END END AS expression,
           'gr' || (l_suppkey % 7)::varchar AS group_ext_id FROM lineitem""")
def lower_vote_rows(d):
    flag, line = F.col("l_returnflag"), F.col("l_linenumber") % 3
    row = as_map(
        v=text("http://x/votazione.rdf/vs19_", F.col("l_orderkey")), dep=text("http://x/deputato.rdf/d", F.col("l_suppkey"), "_19"),
        gruppo=text("http://x/gruppoParlamentare.rdf/gr", F.col("l_suppkey") % 7),
        tipo=F.when(flag == "R", "Favorevole").when(flag == "A", "Contrario").otherwise("Non ha votato"),
        descr=F.when(line == 0, "In missione").when(line == 1, "").otherwise("Non ha partecipato"),
    )
    return CH.lower_votes(d.table("lineitem").select(row))


@query("doubled_lower_ballots", """
    SELECT 'vs19_' || o_orderkey::varchar AS ext_id, o_orderdate::date AS ballot_date, o_custkey::int AS n_for FROM orders""")
def doubled_lower_ballots(d):
    """Every row twice, as the source delivers them, and one more with a linked act."""
    row = lambda act: as_map(
        v=text("http://x/votazione.rdf/vs19_", F.col("o_orderkey")), data=F.date_format("o_orderdate", "yyyyMMdd"), fav=F.col("o_custkey").cast("string"),
        con=F.lit("0"), ast=F.lit("0"), atto=act,
    )
    orders = d.table("orders")
    plain = orders.select(row(F.lit(None).cast("string")))
    return CH.lower_ballots(plain.unionAll(plain).unionAll(orders.select(row(F.lit("http://x/attocamera.rdf/ac19_7")))), 19).select("ext_id", "ballot_date", "n_for")


@query("upper_vote_rows", """
    SELECT '19-' || o_orderkey::varchar || '-1' AS ballot_id, o_custkey::varchar AS person_id,
           CASE o_orderkey % 2 WHEN 0 THEN 'for' ELSE 'on_mission' END AS expression FROM orders""")
def upper_vote_rows(d):
    key = F.col("o_orderkey")
    row = as_map(
        v=text("http://dati/votazione/19-", key, "-1"), sen=text("http://dati/senatore/", F.col("o_custkey")),
        p=text("http://dati/osr/", F.when(key % 2 == 0, "favorevole").otherwise("inCongedoMissione")),
    )
    return CH.upper_votes(d.table("orders").select(row)).select("ballot_id", "person_id", "expression")


@query("selected_vote_scan", """
    SELECT DISTINCT 'u' || l_orderkey::varchar || '-' || l_linenumber::varchar AS vote_uri FROM lineitem
    WHERE l_linenumber % 5 = 0 OR l_suppkey % 11 = 0 OR l_suppkey % 7 = 3""")
def selected_vote_scan(d):
    """Votes without a group, of every eleventh person, or of one group."""
    person = F.col("l_suppkey").cast("string").alias("person_ext_id")
    lines = d.table("lineitem")
    votes = lines.select(
        text("u", F.col("l_orderkey"), "-", F.col("l_linenumber")).alias("vote_uri"), person,
        F.when(F.col("l_linenumber") % 5 != 0, text("gr", F.col("l_suppkey") % 7)).alias("group_ext_id"),
    )
    people = lines.filter("l_suppkey % 11 = 0 OR (l_suppkey % 7 = 3 AND l_linenumber % 5 = 0)").select(person)
    groups = lines.filter("l_suppkey % 7 = 3").select(text("gr", F.col("l_suppkey") % 7).alias("group_ext_id"))
    return CH.selected_votes(votes.unionAll(votes), people, groups).select("vote_uri")


@query("votes_of_ballots", """
    SELECT l_orderkey::varchar AS ballot_ext_id, l_linenumber FROM lineitem
    WHERE l_shipdate::date BETWEEN date '1996-01-01' AND date '1996-06-30' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0)""")
def votes_of_ballots(d):
    votes = d.table("lineitem").select(F.col("l_orderkey").cast("string").alias("ballot_ext_id"), "l_linenumber", F.to_date("l_shipdate").alias("ballot_date"))
    wanted = d.table("orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").cast("string").alias("ballot_ext_id"))
    return CH.votes_of_ballots(votes, wanted, datetime.date(1996, 1, 1), datetime.date(1996, 6, 30)).select("ballot_ext_id", "l_linenumber")


@query("ballots_by_key", """
    SELECT o_orderkey FROM orders WHERE o_orderkey % 6 = 0 AND o_custkey % 2 = 0""")
def ballots_by_key(d):
    """Ballots of a list of (chamber, term, external id), keys repeated and keys of the other chamber among them."""
    ballots = d.table("orders").select(
        F.when(F.col("o_custkey") % 2 == 0, "lower").otherwise("upper").alias("chamber"), F.lit(19).alias("term"), text("b", F.col("o_orderkey")).alias("ext_id"), "o_orderkey"
    )
    keys = d.table("orders").filter("o_orderkey % 6 = 0").select(F.lit("lower").alias("chamber"), F.lit(19).alias("term"), text("b", F.col("o_orderkey")).alias("ext_id"))
    return CH.ballots_of_keys(ballots, keys.unionAll(keys)).select("o_orderkey")


@query("member_names", """
    SELECT c_custkey::varchar AS person_ext_id, 'Mario' AS first_name, 'Rossi ' || c_nationkey::varchar AS last_name FROM customer""")
def member_names(d):
    """Members with several rows: both names come from one of them."""
    row = lambda first, last: as_map(
        d=text("http://x/deputato.rdf/d", F.col("c_custkey"), "_19"), nome=F.lit(first), cognome=text(last, F.col("c_nationkey"))
    )
    people = d.table("customer")
    rows = people.select(row("MARIO", "ROSSI ")).unionAll(people.select(row("ANNA", "VERDI ")))
    return CH.members(rows, "lower", "d", CH.LOWER_MEMBER).select("person_ext_id", "first_name", "last_name")


@query("group_membership_rows", """
    SELECT c_custkey::varchar AS person_ext_id, 'gr' || c_nationkey::varchar AS group_ext_id, date '2022-10-13' AS valid_from,
           CASE WHEN c_custkey % 2 = 0 THEN date '2023-05-01' END AS valid_to FROM customer""")
def group_membership_rows(d):
    row = lambda end: as_map(
        d=text("http://x/deputato.rdf/d", F.col("c_custkey"), "_19"), g=text("http://x/gruppoParlamentare.rdf/gr", F.col("c_nationkey")),
        inizio=F.lit("20221013"), fine=end,
    )
    people = d.table("customer")
    ends = F.when(F.col("c_custkey") % 2 == 0, "20230501")
    return CH.group_memberships(people.select(row(ends)).unionAll(people.select(row(F.lit(None).cast("string")))))


@query("article_items", """
    SELECT page_id AS source, 'https://a.it/' || page_id::varchar AS url, 't ' || page_id::varchar AS title, 'a.it' AS domain FROM pages WHERE page_id % 5 <> 0""")
def article_items(d):
    """Each page as an article-search answer; every fifth is not JSON."""
    n = F.col("page_id")
    body = F.when(n % 5 == 0, "busy").otherwise(text('{"articles":[{"url":"https://A.it/', n, '#x","title":" t ', n, '","domain":"a.it","seendate":"20240101T100000Z"},{"title":"no address"}]}'))
    elements, _ = FE.article_elements(d.table("pages").select(n.alias("source"), body.alias("body")))
    return elements.select("source", "url", "title", "domain")


@query("article_errors", "SELECT page_id AS source, 'busy, try later: ' || repeat('x', 300) AS error FROM pages WHERE page_id % 5 = 0")
def article_errors(d):
    n = F.col("page_id")
    body = F.when(n % 5 == 0, text("busy, try later: ", F.repeat(F.lit("x"), F.lit(300)))).otherwise('{"articles":[]}')
    _, errors = FE.article_elements(d.table("pages").select(n.alias("source"), body.alias("body")))
    return errors.select("source", "error")


@query("channel_items", """
    SELECT page_id AS source, 1 - i AS ord, 'https://t.me/c/' || page_id::varchar || i::varchar AS url, 'First ' || i::varchar AS title, 'First ' || i::varchar || chr(10) || 'second' AS text
    FROM pages, (VALUES (0), (1)) AS v(i)""")
def channel_items(d):
    n = F.col("page_id")
    piece = lambda i: text(f'<div class="msg x" data-post="c/', n, f'{i}"><div class="msg_text">First {i}<br/>second</div><time datetime="2024-01-01T10:00:00+00:00"></time></div>')
    html = text("<html>", piece(0), piece(1), "</html>")
    return FE.channel_elements(d.table("pages").select(n.alias("source"), html.alias("html")), "msg", "msg_text", "https://t.me/").select("source", "ord", "url", "title", "text")


@query("unreadable_feeds", "SELECT page_id AS source, 'unreadable feed' AS error FROM pages WHERE page_id % 4 = 0")
def unreadable_feeds(d):
    n = F.col("page_id")
    xml = F.when(n % 4 == 0, "<html>sorry").when(n % 4 == 1, "<rss><channel><title>none yet</title></channel></rss>").otherwise("<feed><title>t</title></feed>")
    return FE.feed_errors(d.table("pages").select(n.alias("source"), xml.alias("xml")))


@query("active_sources", """
    SELECT s_suppkey::varchar AS source, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS level, s_suppkey % 3 = 2 AS filtered
    FROM supplier WHERE s_suppkey % 5 <> 0""")
def active_sources(d):
    n = F.col("s_suppkey")
    sources = d.table("supplier").select(
        n.cast("string").alias("source"), F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").otherwise("C").alias("level"), F.lit("rss").alias("channel"),
        text("https://s/", n).alias("url"), F.lit(None).cast("string").alias("link_pattern"), F.when(n % 5 == 0, False).when(n % 5 == 1, True).alias("active"),
    )
    return RG.active_sources(sources).select("source", "level", "filtered")


@query("registry_shape", """
    SELECT s_suppkey::varchar AS key, s_name AS detail FROM supplier WHERE NOT regexp_full_match(s_name, '[a-z0-9]+(-[a-z0-9]+)*')""")
def registry_shape(d):
    """Names that are no identifiers."""
    bad = Q.bad_shape(d.table("supplier"), "s_name", Q.SLUG, ["s_suppkey"])
    return bad.select(F.col("key").cast("string").alias("key"), "detail")


@query("unconfirmed_facts", "SELECT c_custkey::varchar AS key, 'period' AS detail FROM customer WHERE c_custkey % 9 = 0")
def unconfirmed_facts(d):
    bad = Q.unconfirmed(d.table("customer"), "period", ["c_custkey"], F.col("c_custkey") % 9 == 0)
    return bad.select(F.col("key").cast("string").alias("key"), "detail")


@query("coverage_gaps", "SELECT DISTINCT c_custkey::varchar AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def coverage_gaps(d):
    covered = d.table("orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return Q.missing_coverage(d.table("customer"), covered, ["c_custkey"], "coverage").select(F.col("key").cast("string").alias("key"))


@query("daily_senders", """
    SELECT event_id, sha256('10.0.' || (user_id % 256)::varchar || '.1' || '|' || strftime(ts::date, '%Y-%m-%d')) AS origin FROM events""")
def daily_senders(d):
    """A report's sender code: it changes every day, and only the first hop counts."""
    hops = text("10.0.", F.col("user_id") % 256, ".1, 172.16.0.", F.col("event_id") % 250)
    return d.table("events").select("event_id", X.daily_origin(hops, F.to_date("ts")).alias("origin"))
