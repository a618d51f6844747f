"""Queries on what is stored: documents, releases, groups, linked people, registries and their shapes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyframe import sinks
from tallyframe.functions import dates
from tallyframe.functions import text as X
from tallyframe.functions import urls as U
from tallyframe.operators import catalogue as C
from tallyframe.operators import collection as CO
from tallyframe.operators import quality as Q
from tallyframe.operators import release as R
from tallyframe.plans import rules as RU
from tallyframe.plans import texts as TX
from tallyframe.plans.registry import query
from tallyframe.sources import chambers as CH
from tallyframe.sources import registry as RG
from tallyframe.storage import fresh_folder, written


@query("saved_documents", """
    SELECT sha256(text) AS sha256, 1 + len(text) % 2 AS extraction, len(string_split(text, chr(10)))::bigint AS paragraphs FROM documents GROUP BY text""")
def saved_documents(d):
    """Documents and their paragraphs saved twice, copies among them: one of each content and reading."""
    folder = fresh_folder(d.spark, "saved")
    docs = TX.documents(d).select(F.sha2("text", 256).alias("sha256"), (1 + F.length("text") % 2).cast("int").alias("extraction"), "text")
    paragraphs = docs.select("sha256", "extraction", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    for _ in range(2):
        sinks.save_documents(docs.drop("text"), paragraphs, folder)
    stored, parts = (d.spark.read.parquet(f"{folder}/{t}") for t in ("documents", "paragraphs"))
    counts = parts.groupBy("document_id").agg(F.count(F.lit(1)).alias("paragraphs"))
    return stored.join(counts, "document_id").select("sha256", "extraction", "paragraphs")


@query("release_registry", """
    SELECT 'v' || (user_id % 3)::varchar AS version, count(*) AS n_rows, count(DISTINCT event_type) AS sections FROM events GROUP BY 1""")
def release_registry(d):
    """Three releases registered twice; a section's rows are the events of its type."""
    folder = fresh_folder(d.spark, "registry")
    rows = d.table("events").groupBy(F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("version"), "event_type").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = written(rows, "manifests")
    for _ in range(2):
        sinks.register_release(rows, folder)
    return d.spark.read.parquet(folder)


@query("new_groups", """
    SELECT sha256('lower|19|' || group_id::varchar) AS group_id, 'lower' AS chamber, 19 AS term, group_id::varchar AS group_ext_id
    FROM (SELECT DISTINCT group_id FROM vote_rows WHERE group_id IS NOT NULL AND group_id % 3 <> 0)""")
def new_groups(d):
    facts = d.shared("vote_rows").select(F.col("group_id").cast("string").alias("group_ext_id"))
    known = d.table("nation").filter("n_nationkey % 3 = 0").select(F.col("n_nationkey").cast("string").alias("group_ext_id"))
    return sinks.new_group_keys(facts, known, "lower", 19)


@query("current_programmes", """
    WITH filed AS (SELECT doc_id, sha256(text) AS sha256, 1 + (doc_id % 3)::int AS extraction FROM documents),
    current AS (SELECT * FROM filed QUALIFY row_number() OVER (PARTITION BY sha256 ORDER BY extraction DESC, doc_id) = 1),
    listed AS (SELECT DISTINCT unnest(['src' || (doc_id % 7)::varchar, 'src' || (doc_id % 5)::varchar]) AS party_id, date '2001-05-13' AS election, sha256 FROM filed)
    SELECT DISTINCT party_id, election, c.doc_id AS document_id FROM listed JOIN current c USING (sha256)""")
def current_programmes(d):
    """Each party of a filed programme with the current reading of its file."""
    name = lambda k: F.concat(F.lit("src"), (F.col("doc_id") % k).cast("string"))
    listed = TX.documents(d).select(F.array(name(7), name(5)).alias("parties"), F.lit("2001-05-13").cast("date").alias("election"), F.sha2("text", 256).alias("sha256"))
    return sinks.programme_links(listed, TX.readings(d))


@query("linked_components", """
    WITH periods AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'lower' ELSE 'upper' END AS chamber, 'x' || c_custkey::varchar AS ext, (c_custkey % 9)::int AS party_id,
        date '1996-01-01' + (c_custkey % 50)::int AS valid_from, date '1999-01-01' AS valid_to FROM customer),
    ids AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'lower' ELSE 'upper' END AS chamber, 'x' || c_custkey::varchar AS ext, c_custkey AS person_id FROM customer WHERE c_custkey % 8 <> 3),
    held AS (SELECT c_custkey AS person_id, (c_custkey % 9)::int AS party_id, date '1996-01-01' + (c_custkey % 50)::int AS valid_from FROM customer WHERE c_custkey % 5 = 0)
    SELECT 'stored' AS outcome, person_id::varchar AS key, p.party_id::varchar AS party_id FROM periods p JOIN ids USING (chamber, ext)
      WHERE p.party_id < 5 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.person_id = ids.person_id AND h.party_id = p.party_id AND h.valid_from = p.valid_from)
    UNION ALL SELECT DISTINCT 'missing', chamber || ':' || ext, NULL FROM periods p WHERE NOT EXISTS (SELECT 1 FROM ids i WHERE i.chamber = p.chamber AND i.ext = p.ext)
    UNION ALL SELECT DISTINCT 'unknown', NULL, party_id::varchar FROM periods WHERE party_id >= 5""")
def linked_components(d):
    key = F.col("c_custkey")
    chamber = F.when(key % 2 == 0, "lower").otherwise("upper").alias("chamber")
    ext = F.concat(F.lit("x"), key.cast("string")).alias("person_ext_id")
    party, start = (key % 9).cast("int").alias("party_id"), F.date_add(F.lit("1996-01-01").cast("date"), (key % 50).cast("int")).alias("valid_from")
    customers = d.table("customer")
    new, missing, unknown = CH.linked_components(
        customers.select(chamber, ext, party, start, F.lit("1999-01-01").cast("date").alias("valid_to")),
        customers.filter(key % 8 != 3).select(chamber, ext, key.alias("person_id")), d.table("region").select(F.col("r_regionkey").alias("party_id")),
        customers.filter(key % 5 == 0).select(key.alias("person_id"), party, start),
    )
    nothing = F.lit(None).cast("string")
    return (
        new.select(F.lit("stored").alias("outcome"), F.col("person_id").cast("string").alias("key"), F.col("party_id").cast("string").alias("party_id"))
        .unionByName(missing.select(F.lit("missing").alias("outcome"), F.concat_ws(":", "chamber", "person_ext_id").alias("key"), nothing.alias("party_id")))
        .unionByName(unknown.select(F.lit("unknown").alias("outcome"), nothing.alias("key"), F.col("party_id").cast("string").alias("party_id")))
    )


@query("both_chambers", """
    WITH rows_ AS (SELECT CASE WHEN person_id % 3 = 0 THEN 'upper' ELSE 'lower' END AS chamber, person_id, group_id, valid_from, valid_to FROM memberships WHERE kind = 'group'
      UNION ALL SELECT CASE WHEN person_id % 3 = 0 THEN 'upper' ELSE 'lower' END, person_id, group_id, valid_from, date '1996-01-01' FROM memberships WHERE kind = 'group' AND person_id % 4 = 0)
    SELECT chamber, person_id, group_id, valid_from, CASE WHEN bool_or(valid_to IS NULL) THEN NULL ELSE max(valid_to) END AS valid_to FROM rows_ GROUP BY 1, 2, 3, 4""")
def both_chambers(d):
    rows = d.shared("memberships").filter("kind = 'group'").select("person_id", "group_id", "valid_from", "valid_to")
    rows = rows.unionByName(rows.filter("person_id % 4 = 0").withColumn("valid_to", F.lit("1996-01-01").cast("date")))
    return CH.of_both_chambers(rows.filter("person_id % 3 <> 0"), rows.filter("person_id % 3 = 0"), ["person_id", "group_id", "valid_from"])


@query("instants", """
    SELECT event_id, CASE event_id % 5 WHEN 3 THEN date_trunc('day', ts) WHEN 4 THEN NULL ELSE date_trunc('second', ts) END AS at FROM events""")
def instants(d):
    """Times written as feeds, sitemaps and search answers write them; one in five is no time."""
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_id") % 5
    said = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssXXX")).when(kind == 1, F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'"))
        .when(kind == 2, F.date_format(ts, "EEE, d MMM yyyy HH:mm:ss Z")).when(kind == 3, F.date_format(ts, "yyyy-MM-dd")).otherwise(F.lit("soon"))
    )
    return d.table("events").select("event_id", dates.instant(said).alias("at"))


@query("first_samples", "SELECT user_id, event_id FROM events WHERE event_type = 'error' ORDER BY value DESC, event_id LIMIT 5")
def first_samples(d):
    rows = d.table("events").filter("event_type = 'error'")
    return R.first_samples(rows, [F.col("value").desc(), F.col("event_id")]).select("user_id", "event_id")


@query("plain_filters", """
    SELECT c_custkey, lower(c_mktsegment) IN ('building', 'machinery') AS listed, starts_with(c_name, 'Customer#00000') OR starts_with(c_name, 'customer') AS prefixed,
      c_custkey % 6 < 2 AS unbound FROM customer""")
def plain_filters(d):
    note = F.when(F.col("c_custkey") % 6 == 0, " ").when(F.col("c_custkey") % 6 > 1, "x")
    return d.table("customer").select(
        "c_custkey", X.any_case_in(F.col("c_mktsegment"), ["Building", "MACHINERY"]).alias("listed"),
        X.starts_with_any(F.col("c_name"), ["Customer#00000", "customer"]).alias("prefixed"), X.unbound(note).alias("unbound"),
    )


@query("registry_shapes", """
    SELECT 'range_p_size' AS "check", p_partkey::varchar AS key, p_size::varchar AS detail FROM part WHERE p_size NOT BETWEEN 5 AND 45
    UNION ALL SELECT 'length_p_name', p_partkey::varchar, length(p_name)::varchar FROM part WHERE length(p_name) NOT BETWEEN 12 AND 30
    UNION ALL SELECT 'scale_size', (p_partkey % 40)::varchar, count(*)::varchar FROM part GROUP BY p_partkey % 40 HAVING count(*) <> 5
    UNION ALL SELECT 'scale_order', k::varchar, max(n)::varchar FROM (SELECT p_partkey % 40 AS k, count(*) OVER (PARTITION BY p_partkey % 40) AS n,
        p_size - lag(p_size) OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS step FROM part) GROUP BY k HAVING max(n) > 1 AND bool_or(step <= 0)
    UNION ALL SELECT 'default_rule', (o_orderkey % 50)::varchar, count(*) FILTER (o_orderstatus = 'P')::varchar FROM orders GROUP BY o_orderkey % 50
      HAVING count(*) FILTER (o_orderstatus = 'P') > 1 OR max_by(o_orderstatus, o_orderkey) <> 'P'""")
def registry_shapes(d):
    """Ranges, lengths, scales of five rising levels, and rule lists that end in a rule without a condition."""
    parts = d.table("part").withColumn("scale", F.col("p_partkey") % 40)
    rules_ = d.table("orders").select((F.col("o_orderkey") % 50).alias("list"), "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("when"))
    return (
        Q.out_of_range(parts, "p_size", 5, 45, ["p_partkey"]).unionByName(Q.bad_length(parts, "p_name", 12, 30, ["p_partkey"]))
        .unionByName(Q.scale_of_levels(parts, "scale", "p_partkey", "p_size")).unionByName(Q.last_rule_is_default(rules_, "list", "o_orderkey", "when"))
    )


@query("cross_references", """
    WITH groups_ AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 <> 1 THEN n_name END AS ext_id, CASE WHEN n_nationkey % 3 = 0 THEN 'unsure' ELSE 'verified' END AS status FROM nation)
    SELECT 'verified_without_id' AS "check", k::varchar AS key, status AS detail FROM groups_ WHERE status = 'verified' AND ext_id IS NULL
    UNION ALL SELECT 'other_term', ballot_id::varchar, term::varchar FROM ballot_facts WHERE term <> 19""")
def cross_references(d):
    key = F.col("n_nationkey")
    groups = d.table("nation").select(key, F.when(key % 4 != 1, F.col("n_name")).alias("ext_id"), F.when(key % 3 == 0, "unsure").otherwise("verified").alias("status"))
    return Q.verified_without_id(groups, ["n_nationkey"]).unionByName(Q.other_term(d.shared("ballot_facts"), ["ballot_id"], 19))


@query("registry_dimensions", """
    SELECT 'party_roles' AS dimension, 'p' || r_regionkey::varchar AS a, 'government' AS b, date '1996-05-01' AS valid_from FROM region WHERE r_regionkey % 2 = 0
    UNION ALL SELECT 'group_party', 'g' || n_nationkey::varchar, 'p' || n_regionkey::varchar, CASE WHEN n_nationkey % 2 = 0 THEN date '1997-03-01' ELSE date '1996-05-09' END FROM nation WHERE n_nationkey % 3 <> 0
    UNION ALL SELECT 'memberships', 'c' || c_custkey::varchar, 'p' || (c_custkey % 5)::varchar, CASE WHEN c_custkey % 4 = 0 THEN date '1998-01-01' ELSE date '1996-05-09' END FROM customer""")
def registry_dimensions(d):
    """Parties, verified groups and tracked people out of registries, one entry a file, as dimension tables with their periods."""
    since = lambda text: F.lit(text).cast("date")
    region, nation, customer = (d.table(t) for t in ("region", "nation", "customer"))
    slug = lambda letter, c: F.concat(F.lit(letter), c.cast("string"))
    parties = region.select(F.array(F.struct(
        slug("p", F.col("r_regionkey")).alias("slug"), F.col("r_name").alias("name"), F.array(F.struct(
            F.when(F.col("r_regionkey") % 2 == 0, "government").otherwise("opposition").alias("role"),
            F.when(F.col("r_regionkey") % 2 == 0, since("1996-05-01")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))).alias("roles"),
    )).alias("parties"))
    groups = nation.select(F.array(F.struct(
        F.lit("lower").alias("chamber"), F.lit(19).alias("term"), slug("g", F.col("n_nationkey")).alias("ext_id"), F.col("n_name").alias("name"),
        F.when(F.col("n_nationkey") % 3 == 0, "unsure").otherwise("verified").alias("status"), F.array(slug("p", F.col("n_regionkey"))).alias("parties"),
        F.when(F.col("n_nationkey") % 2 == 0, since("1997-03-01")).alias("valid_from"),
    )).alias("groups"))
    none = F.array().cast("array<string>")
    people = customer.select(F.array(F.struct(
        slug("c", F.col("c_custkey")).alias("slug"), F.col("c_name").alias("first_name"), F.col("c_name").alias("last_name"), slug("p", F.col("c_custkey") % 5).alias("party"),
        none.alias("forms"), none.alias("excluded_forms"), F.array(
            F.struct(F.lit("x").alias("office"), F.lit("").alias("party"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to")),
            F.struct(F.lit("y").alias("office"), F.lit("").alias("party"), F.when(F.col("c_custkey") % 4 == 0, since("1998-01-01")).alias("valid_from"), F.lit(None).cast("date").alias("valid_to")),
        ).alias("offices"),
    )).alias("people"))
    dims = RG.dimensions(parties, groups, people, "1996-05-09")

    def told(name, a, b):
        return dims[name].select(F.lit(name).alias("dimension"), F.col(a).alias("a"), F.col(b).alias("b"), "valid_from")

    return told("party_roles", "party_id", "role").unionByName(told("group_party", "group_id", "party_id")).unionByName(told("memberships", "person_id", "party_id"))


@query("full_report", f"""
    WITH {RU.CANDIDATES_SQL}, {RU.DRAFTS_SQL}, {RU.TESTS_SQL},
    whole AS (SELECT t.*, theme_ok AND sensitivity_ok AND polarity_ok AS passed, f.seq FROM tests t JOIN ballot_facts f ON 'd' || f.seq::varchar = t.statement_id),
    kept AS (SELECT * FROM whole WHERE NOT (seq % 4 = 0 AND seq % 8 <> 0))
    SELECT 'data' AS part, 'candidates' AS name, count(*) FILTER (reason IS NULL) AS n FROM judged
    UNION ALL SELECT 'discarded_by_data', reason, count(*) FROM judged WHERE reason IS NOT NULL GROUP BY 2
    UNION ALL SELECT 'model', 'generated', count(*) FILTER (text <> '') FROM drafts UNION ALL SELECT 'model', 'discarded', count(*) FILTER (text = '') FROM drafts
    UNION ALL SELECT 'statements', 'verified', count(*) FROM whole UNION ALL SELECT 'statements', 'left', count(*) FROM kept UNION ALL SELECT 'statements', 'passed', count(*) FILTER (passed) FROM kept
    UNION ALL SELECT 'failed', 'theme', count(*) FILTER (NOT theme_ok) FROM kept UNION ALL SELECT 'failed', 'sensitivity', count(*) FILTER (NOT sensitivity_ok) FROM kept
    UNION ALL SELECT 'failed', 'polarity', count(*) FILTER (NOT polarity_ok) FROM kept
    UNION ALL SELECT 'passed_per_theme', t.theme, count(k.theme) FROM (VALUES ('t0'), ('t1'), ('t2'), ('t3'), ('t4'), ('t5')) t(theme) LEFT JOIN kept k ON k.theme = t.theme AND k.passed GROUP BY 2""")
def full_report(d):
    facts = d.shared("ballot_facts").select("ballot_id", "seq")
    drafts = RU.drafts(d)
    excluded = facts.filter("seq % 4 = 0").select("ballot_id", F.when(F.col("seq") % 8 == 0, " ").otherwise("withdrawn").alias("reason"))
    tests = RU.tests(d).join(drafts.select("statement_id", "ballot_id"), "statement_id")
    return C.full_report(RU.judged(d), drafts.select("statement_id", (F.col("text") == "").alias("discard")), tests, excluded, RU.THEMES)


@query("visible_phrases", r"""
    WITH bare AS (SELECT page_id, regexp_replace(regexp_replace(html, '<!--[\s\S]*?-->|/\*[\s\S]*?\*/', ' ', 'g'), '(?m)(^|[ \t\r\n\f])//[ \t\r\f].*$', ' ', 'g') AS t FROM pages),
    found AS (SELECT page_id, list_transform(regexp_extract_all(t, '"(?:[^"\n]*\n[^"\n]*|[^" \t\r\n\f]*[ \t\r\f][^"\n]*)"|''(?:[^''\n]*\n[^''\n]*|[^'' \t\r\n\f]*[ \t\r\f][^''\n]*)''|`[^`]*[ \t\r\n\f][^`]*`'),
        lambda q: substr(q, 2, length(q) - 2))
      || regexp_extract_all(t, '(?:<[A-Za-z][A-Za-z0-9_-]*(?:[ \t\r\n\f][^<>]*)?>|</[A-Za-z][A-Za-z0-9_-]*>)([^<>{}]*[A-Za-zàèéìòùÀÈÉÌÒÙ][^<>{}]*)', 1) AS phrases FROM bare)
    SELECT page_id, unnest(range(len(phrases)))::int AS place, unnest(phrases) AS phrase FROM found""")
def visible_phrases(d):
    return d.table("pages").select("page_id", F.posexplode(X.visible_phrases(F.col("html"))).alias("place", "phrase"))


@query("party_order", """
    WITH names AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'É' || lower(n_name) WHEN 2 THEN 'e' || n_name ELSE n_name END AS name FROM nation)
    SELECT k, name, row_number() OVER (ORDER BY name COLLATE it, k) AS place FROM names""")
def party_order(d):
    """The registry's names in the order of the language of the publication: a short list, numbered whole."""
    kind = F.col("n_nationkey") % 4
    name = F.when(kind == 0, F.lower("n_name")).when(kind == 1, F.concat(F.lit("É"), F.lower("n_name"))).when(kind == 2, F.concat(F.lit("e"), "n_name")).otherwise(F.col("n_name"))
    named = d.table("nation").select(F.col("n_nationkey").alias("k"), name.alias("name"))
    ordered = R.alphabetical(named, "name", "k")
    return ordered.withColumn("place", F.row_number().over(Window.orderBy(F.collate(F.col("name"), "it"), "k")).cast("long"))


@query("upper_ballot_rows", """
    WITH t AS (SELECT o_orderkey AS k, o_orderdate::date AS day FROM orders)
    SELECT 'upper' AS chamber, 19 AS term, '19-' || k::varchar || '-1' AS ext_id, day AS ballot_date,
      CASE WHEN k % 3 = 0 THEN 'Votazione finale' WHEN k % 3 = 1 THEN 'Questione di fiducia' ELSE 'Articolo 1' END AS kind, k % 3 = 0 AS is_final, k % 3 = 1 AS is_confidence,
      (k % 90)::int AS n_for, (k % 50)::int AS n_against, CASE WHEN k % 2 = 0 THEN (k % 7)::int ELSE 0 END AS n_abstain,
      CASE k % 5 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN false END AS approved, k % 11 = 0 AS is_secret,
      CASE WHEN k % 4 = 0 THEN 'S.' || (k % 100)::varchar || ', S.' || (k % 100 + 1)::varchar WHEN k % 4 = 3 THEN NULL ELSE 'S.' || (k % 100)::varchar END AS act_ref,
      CASE WHEN k % 4 IN (1, 2) THEN 'Titolo ' || (k % 100)::varchar END AS act_title FROM t""")
def upper_ballot_rows(d):
    """Rows of the upper chamber: one per linked bill, two for every fourth ballot, an absorbed one beside the only bill of others."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    phase = lambda n: F.concat(F.lit("S."), text(k % 100 + n))
    bills = F.when(k % 4 == 0, F.array(F.lit(0), F.lit(1))).when(k % 4 == 1, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))
    flat = d.table("orders").select("o_orderkey", "o_orderdate", F.posexplode(bills).alias("i", "bill"))
    bill = F.col("bill")
    entries = {
        "v": F.concat(F.lit("http://x/votazione/19-"), text(k), F.lit("-1")), "data": F.date_format("o_orderdate", "yyyy-MM-dd"),
        "label": F.when(k % 3 == 0, "Votazione finale").when(k % 3 == 1, "Questione di fiducia").otherwise("Articolo 1"),
        "fav": text(k % 90), "con": text(k % 50), "ast": F.when(k % 2 == 0, text(k % 7)),
        "esito": F.when(k % 5 == 0, "approvato").when(k % 5 == 1, "Respinto").when(k % 5 == 2, "non approvato").otherwise("rinviato"),
        "tipoVot": F.when(k % 11 == 0, "Segreta").otherwise("Palese"),
        "ddl": F.when(k % 4 != 3, F.concat_ws("-", text(k), text(bill))), "fase": F.when(k % 4 != 3, phase(bill)),
        "stato": F.when(bill == 2, "assorbito").otherwise("approvato"), "titolo": F.when(k % 4 != 3, F.concat(F.lit("Titolo "), text(k % 100 + bill))),
    }
    row = F.map_filter(F.create_map(*[x for n, c in entries.items() for x in (F.lit(n), text(c))]), lambda _, v: v.isNotNull())
    found = CH.upper_ballots(flat.select((k * 2 + F.col("i")).alias("ord"), row.alias("row")), 19)
    return found.select("chamber", "term", "ext_id", "ballot_date", "kind", "is_final", "is_confidence", "n_for", "n_against", "n_abstain", "approved", "is_secret", "act_ref", "act_title")


@query("source_quota", """
    SELECT page_id, source, row_number() OVER (PARTITION BY source ORDER BY page_id) <= 30 AS now
    FROM (SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) AS source FROM pages)""")
def source_quota(d):
    """Thirty new pages of each source a pass; the others are listed as waiting."""
    pages = d.table("pages").select("page_id", U.host(F.col("url")).alias("source"))
    return CO.with_quota(pages, "source", ["page_id"], 30)


MONTHS = "list_extract(['gennaio', 'febbraio', 'marzo', 'aprile', 'maggio', 'giugno', 'luglio', 'agosto', 'settembre', 'ottobre', 'novembre', 'dicembre'], month(ballot_date)::int)"


@query("statement_records", f"""
    WITH {RU.DRAFTS_SQL}, {RU.TESTS_SQL}
    SELECT replace(lower('e-' || f.chamber || '-' || f.ext_id), '_', '-') AS id, 'Misura ' || f.seq::varchar AS text, d.theme,
      'Se n''è votato ' || CASE f.chamber WHEN 'lower' THEN 'alla Camera' ELSE 'al Senato' END || ' il ' || day(f.ballot_date)::varchar || ' ' || {MONTHS.replace("ballot_date", "f.ballot_date")} || ' ' ||
        year(f.ballot_date)::varchar || ': la legge è stata ' || CASE WHEN f.approved THEN 'approvata' WHEN NOT f.approved THEN 'respinta' ELSE 'votata' END || '.' AS fact,
      'pro ' || d.theme AS pro, 'con ' || d.theme AS con, f.act_ref, sha256(f.act_title) AS input_sha, f.ballot_date AS date, theme_ok AND sensitivity_ok AND polarity_ok AS passed
    FROM drafts d JOIN ballot_facts f USING (ballot_id) JOIN tests t USING (statement_id) WHERE f.seq % 3 <> 1""")
def statement_records(d):
    """Statements assembled, then published: the active ones with their context."""
    facts, drafts = d.shared("ballot_facts"), RU.drafts(d)
    answers = drafts.join(facts.select("ballot_id", "seq"), "ballot_id").filter("seq % 3 <> 1").select(
        "ballot_id", F.concat(F.lit(" Misura "), F.col("seq").cast("string")).alias("statement"), "theme",
        F.concat(F.lit("pro "), "theme").alias("pro"), F.concat(F.lit("con "), "theme", F.lit(" ")).alias("con"),
    )
    tests = RU.tests(d).drop("theme").join(drafts.select("statement_id", "ballot_id"), "statement_id")
    made = C.statement_records(facts.join(drafts.select("ballot_id", "minority"), "ballot_id"), answers, tests, "m1", "p1")
    cards = R.active_questions(made.withColumnRenamed("id", "statement_id"))
    more = made.select("id", F.col("origin.act_ref").alias("act_ref"), F.col("origin.generation.input_sha").alias("input_sha"),
                       (F.col("tests.theme") & F.col("tests.sensitivity") & F.col("tests.polarity")).alias("passed"))
    return cards.join(more, "id").select("id", "text", "theme", "context.fact", "context.pro", "context.con", "act_ref", "input_sha", "date", "passed")
