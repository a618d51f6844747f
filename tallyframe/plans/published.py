"""Queries on what is published and on the small joins around it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import dates, rules
from tallyframe.functions import text as X
from tallyframe.operators import catalogue as C
from tallyframe.operators import documents as D
from tallyframe.operators import release as R
from tallyframe.plans import rules as RU
from tallyframe.plans import texts as TX
from tallyframe.plans.registry import query
from tallyframe.sources import feeds as FE
from tallyframe.sources import pages as PG


@query("active_questions", f"""
    WITH {RU.DRAFTS_SQL}
    SELECT d.statement_id AS id, d.text, d.theme, d.ballot_date AS date, f.chamber FROM drafts d JOIN ballot_facts f USING (ballot_id)
    WHERE f.seq % 3 = 0""")
def active_questions(d):
    facts = d.shared("ballot_facts").select("ballot_id", "chamber", "term", "ext_id", "seq")
    rows = RU.drafts(d).join(facts, "ballot_id").select(
        "statement_id", "text", "theme", F.when(F.col("seq") % 3 == 0, "active").otherwise("withdrawn").alias("status"),
        F.struct("chamber", "term", "ext_id", F.col("ballot_date").alias("date")).alias("origin"),
    )
    return R.active_questions(rows)


@query("statement_keys", """
    SELECT ballot_id, 'e-' || chamber || '-' || ext_id AS id, coalesce(act_title, act_ref, '') AS title,
           day(ballot_date)::varchar || ' ' || list_extract(['gennaio', 'febbraio', 'marzo', 'aprile', 'maggio', 'giugno', 'luglio',
             'agosto', 'settembre', 'ottobre', 'novembre', 'dicembre'], month(ballot_date)::int) || ' ' || year(ballot_date)::varchar AS day,
           CASE WHEN day(ballot_date) IN (8, 11) THEN 'all''' ELSE 'al ' END || day(ballot_date)::varchar AS article,
           CASE WHEN approved THEN 'Yes' WHEN NOT approved THEN 'No' ELSE 'Unknown' END AS said
    FROM ballot_facts""")
def statement_keys(d):
    day = F.col("ballot_date")
    value = F.when(F.col("approved"), 2).when(~F.col("approved"), -2)
    nothing = F.lit(None).cast("string")
    return d.shared("ballot_facts").select(
        "ballot_id", C.statement_key(F.col("chamber"), F.col("ext_id")).alias("id"),
        R.ballot_title(F.col("act_title"), nothing, nothing, F.col("act_ref")).alias("title"),
        dates.date_in_words(day).alias("day"),
        F.regexp_extract(dates.as_of_words(day), r"^(\S+? ?\d+)", 1).alias("article"),
        rules.position_in_words(value).alias("said"),
    )


@query("corrections", """
    SELECT ts::date AS day, 'ballot:' || event_id::varchar AS object, event_type AS before,
           CASE WHEN event_id % 2 = 0 THEN event_type ELSE props END AS after, 'typo' AS reason FROM events""")
def corrections(d):
    quoted = F.concat(F.lit('"'), "event_type", F.lit('"'))
    rows = d.table("events").select(
        F.col("ts").alias("published_at"), F.lit("ballot").alias("object_kind"), F.col("event_id").cast("string").alias("object_id"),
        F.concat(F.lit('{"testo": '), quoted, F.lit("}")).alias("before"),
        F.when(F.col("event_id") % 2 == 0, quoted).otherwise(F.col("props")).alias("after"), F.lit("typo").alias("reason"),
    )
    return R.corrections(rows)


@query("themed_share", f"""
    WITH {TX.PROMISES_SQL},
    counts AS (SELECT document_id, count(*) AS promises, count(*) FILTER (theme = 't0') AS t0, count(*) FILTER (theme = 't1') AS t1,
                      count(*) FILTER (theme = 't2') AS t2, count(*) FILTER (theme = 't3') AS t3 FROM promises GROUP BY 1)
    SELECT DISTINCT party_id, document_id, coalesce(t0 + t1 + t2 + t3, 0) AS themed, coalesce(promises, 0) AS promises,
           coalesce(greatest(t0, t1, t2, t3), 0) AS scale
    FROM programmes LEFT JOIN counts USING (document_id) WHERE election = date '2001-05-13'""")
def themed_share(d):
    return R.themed_share(TX.programme_metrics(d), TX.PROGRAMME_THEMES)


@query("rejected_samples", """
    SELECT user_id, event_id FROM events WHERE event_type = 'error'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3""")
def rejected_samples(d):
    rejected = d.table("events").filter("event_type = 'error'").select("user_id", "event_id")
    return R.samples_of_rejected(rejected, "user_id", [F.col("event_id")])


@query("already_themed", """
    SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') AS done FROM customer""")
def already_themed(d):
    done = d.table("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.flagged_done(d.table("customer").select("c_custkey"), done, "c_custkey")


@query("documents_of_party", f"""
    WITH {TX.PROMISES_SQL}
    SELECT doc_id AS document_id FROM documents WHERE doc_id IN (SELECT document_id FROM programmes WHERE party_id = 'src2')""")
def documents_of_party(d):
    docs = TX.documents(d).select(F.col("doc_id").alias("document_id"))
    return R.of_party(docs, TX.programmes(d), "src2")


@query("optional_parts", """
    SELECT o_orderkey, n_lines, last_ship FROM orders
    LEFT JOIN (SELECT l_orderkey AS o_orderkey, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) USING (o_orderkey)
    LEFT JOIN (SELECT l_orderkey AS o_orderkey, max(l_shipdate)::date AS last_ship FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
      USING (o_orderkey)""")
def optional_parts(d):
    lines = d.table("lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    returned = lines.filter("l_returnflag = 'R'").groupBy("o_orderkey").agg(F.count("*").alias("value"))
    shipped = lines.filter("l_linestatus = 'F'").groupBy("o_orderkey").agg(F.to_date(F.max("l_shipdate")).alias("value"))
    return R.with_optional_parts(
        d.table("orders").select("o_orderkey"), "o_orderkey", {"n_lines": returned, "last_ship": shipped}
    )


@query("path_reservation", r"""
    WITH rules AS (SELECT DISTINCT host, ord, location, reservation FROM (
        SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, unnest([1, 2]) AS ord, unnest(['/en/1*', '/en/*']) AS location,
               unnest(['0', '1']) AS reservation FROM pages WHERE page_id % 2 = 0)),
    placed AS (SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, coalesce((SELECT reservation = '1' FROM rules r WHERE r.host = p.host AND p.path GLOB r.location ORDER BY ord LIMIT 1), false)
      AS reserved FROM placed p""")
def path_reservation(d):
    from tallyframe.functions import urls as U

    rule = F.explode(F.array(
        F.struct(F.lit(1).alias("ord"), F.lit("/en/1*").alias("location"), F.lit("0").alias("reservation")),
        F.struct(F.lit(2).alias("ord"), F.lit("/en/*").alias("location"), F.lit("1").alias("reservation")),
    )).alias("_r")
    made = d.table("pages").filter("page_id % 2 = 0").select(U.host(F.col("url")).alias("host"), rule)
    return PG.path_reservation(d.table("pages").select("page_id", "url"), made.select("host", "_r.*").distinct())


@query("outcome_approved", """
    SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS approved FROM orders""")
def outcome_approved(d):
    """Outcome texts of the upper chamber: the negative is read before the positive it contains."""
    from tallyframe.sources.chambers import approved

    key = F.col("o_orderkey") % 3
    said = F.when(key == 0, "Approvato").when(key == 1, "NON APPROVATO").otherwise("rinviato")
    return d.table("orders").select("o_orderkey", approved(said).alias("approved"))


@query("shortened_titles", r"""
    WITH squeezed AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, CASE WHEN length(t) > 120 THEN rtrim(substr(t, 1, 119)) || '…' ELSE t END AS title FROM squeezed""")
def shortened_titles(d):
    from tallyframe.operators.positions import shorten

    return TX.documents(d).select("doc_id", shorten(F.col("text")).alias("title"))


@query("reserved_pages", """
    SELECT page_id, page_id % 5 = 0 AS reserved FROM pages""")
def reserved_pages(d):
    mark = F.when(F.col("page_id") % 5 == 0, '<META name="tdm-reservation"  content="1">').otherwise(
        '<meta name="tdm-reservation" content="0">'
    )
    return d.table("pages").select("page_id", X.reserves_rights(F.concat("html", mark)).alias("reserved"))


@query("document_fingerprints", """
    SELECT doc_id, sha256(lang || chr(10) || coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE text END, '')) AS sha256 FROM documents""")
def document_fingerprints(d):
    body = F.when(F.col("doc_id") % 3 != 0, F.col("text"))
    return TX.documents(d).select("doc_id", X.fingerprint(F.col("lang"), body).alias("sha256"))


@query("same_document", """
    SELECT d.doc_id AS document_id, d.source AS party_id, coalesce((SELECT string_agg(source, ',' ORDER BY source) FROM
      (SELECT DISTINCT e.source FROM documents e WHERE e.text = d.text AND e.source <> d.source) x), '') AS partners
    FROM documents d""")
def same_document(d):
    named = TX.documents(d).select(F.col("doc_id").alias("document_id"), F.col("source").alias("party_id"), "text")
    groups = D.content_groups(named)
    return groups.select("document_id", "party_id", F.array_join(F.array_remove("parties", F.col("party_id")), ",").alias("partners"))


# ---- landed sources -------------------------------------------------------------------------------------------------

# Pages as sitemap entries, grouped by ten; every third entry has no date.
_DAY = "date_add(date '2024-01-01', cast(page_id % 28 as int))"


@query("sitemap", """
    WITH entries AS (
      SELECT page_id // 10 AS map_id, page_id % 10 AS pos, 'https://site' || (page_id // 10)::varchar || '.example.com/news/' || page_id::varchar AS link,
             CASE WHEN page_id % 3 <> 0 THEN timestamp '2024-01-01' + to_days((page_id % 28)::int) END AS published_at FROM pages)
    SELECT map_id, link, published_at, row_number() OVER (PARTITION BY map_id ORDER BY published_at DESC NULLS LAST, pos) AS rank FROM entries""")
def sitemap(d):
    link = F.concat(F.lit("https://site"), F.expr("cast(page_id div 10 as string)"), F.lit(".example.com/news/"), F.col("page_id").cast("string"))
    day = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<lastmod>"), F.expr(f"cast({_DAY} as string)"), F.lit("</lastmod>"))).otherwise("")
    entry = F.concat(F.lit("<url><loc>"), link, F.lit("</loc>"), day, F.lit("</url>"))
    rows = d.table("pages").select(F.expr("page_id div 10").alias("map_id"), "page_id", entry.alias("e"))
    maps = rows.groupBy("map_id").agg(F.sort_array(F.collect_list(F.struct("page_id", "e"))).alias("es")).select(
        "map_id", F.concat(F.lit('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), F.array_join("es.e", ""), F.lit("</urlset>")).alias("xml")
    )
    return PG.sitemap_links(maps, "map_id", "/news/").select("map_id", "link", "published_at", "rank")


@query("feed_items", """
    SELECT page_id % 3 AS kind, 'https://feed.example.com/' || page_id::varchar AS url, 'Item ' || page_id::varchar AS title, 'Short ' || page_id::varchar AS summary,
           timestamp '2024-01-01 10:00:00' + to_days((page_id % 28)::int) AS published_at FROM pages""")
def feed_items(d):
    """Each page as a feed of one item: RSS 2, RSS 1 and Atom in turn."""
    n, kind = F.col("page_id").cast("string"), F.col("page_id") % 3
    day = F.concat(F.expr(f"cast({_DAY} as string)"), F.lit("T10:00:00Z"))
    url, title, short = F.concat(F.lit("https://feed.example.com/"), n), F.concat(F.lit("Item "), n), F.concat(F.lit("Short "), n)
    tag = lambda name, x: F.concat(F.lit(f"<{name}>"), x, F.lit(f"</{name}>"))
    item = F.concat(F.lit("<item>"), tag("title", title), tag("link", url), tag("description", short), tag("dc:date", day), F.lit("</item>"))
    entry = F.concat(F.lit("<entry>"), tag("title", title), F.lit('<link rel="self" href="https://x.example.com/self"/><link href="'), url, F.lit('"/>'),
                     tag("summary", short), tag("updated", day), F.lit("</entry>"))
    dc = 'xmlns:dc="http://purl.org/dc/elements/1.1/"'
    xml = (
        F.when(kind == 0, F.concat(F.lit(f'<rss version="2.0" {dc}><channel><title>t</title>'), item, F.lit("</channel></rss>")))
        .when(kind == 1, F.concat(F.lit(f'<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" {dc}><channel><title>t</title></channel>'), item, F.lit("</rdf:RDF>")))
        .otherwise(F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>t</title>'), entry, F.lit("</feed>")))
    )
    feeds = d.table("pages").select(kind.alias("source"), xml.alias("xml"))
    return FE.feed_elements(feeds).select(F.col("source").alias("kind"), "url", "title", "summary", "published_at")


@query("decoded_pages", """
    SELECT doc_id, text FROM documents""")
def decoded_pages(d):
    """Every text as a page's bytes, in a charset it declares, an unknown one, or none; decoded and its head taken off again."""
    kind = F.col("doc_id") % 3
    head = F.when(kind == 0, '<html><head><meta charset="utf-8"></head>').when(kind == 1, '<html><head><meta charset="x-nobody"></head>').otherwise("<html><head></head>")
    body = F.encode(F.concat(head, "text"), "UTF-8")
    text = PG.decode(body)
    return d.table("documents").select("doc_id", F.regexp_replace(text, "(?s)^<html><head>.*?</head>", "").alias("text"))


@query("law_key_long", """
    SELECT doc_id, lower(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_]+', ' ', 'g'), '^ | $', '', 'g')) AS law FROM documents""")
def law_key_long(d):
    """Whole texts as titles: the key has no limit of length."""
    return d.table("documents").select("doc_id", X.law_key(F.col("text")).alias("law"))
