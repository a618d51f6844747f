"""Queries on landed source rows, data quality and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe import sinks
from tallyframe.operators import imports as IM
from tallyframe.operators import quality as Q
from tallyframe.operators import temporal as T
from tallyframe.operators import votes as V
from tallyframe.plans import rules as RU
from tallyframe.plans import record as RE
from tallyframe.plans import texts as TX
from tallyframe.plans.registry import query
from tallyframe.sources import bindings as B
from tallyframe.sources import chambers as CH
from tallyframe.storage import fresh_folder, written
from tallyframe.tables import KeyedTable, Ledger

# ---- landed rows ----------------------------------------------------------------------------------------------------


def _map(**columns):
    entries = []
    for name, column in columns.items():
        entries += [F.lit(name), column.cast("string")]
    return F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())


@query("decode_expression", """
    SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 0 THEN 'for' WHEN 1 THEN 'against' WHEN 2 THEN 'abstain'
      WHEN 3 THEN 'secret_voter' WHEN 4 THEN CASE l_orderkey % 5 WHEN 0 THEN 'not_voting' WHEN 1 THEN 'absent' WHEN 2 THEN 'on_mission'
        WHEN 3 THEN 'president' END WHEN 5 THEN 'not_voting' END AS expression FROM lineitem""")
def decode_expression(d):
    kind = F.col("l_linenumber") % 7
    why = F.col("l_orderkey") % 5
    said = (
        F.when(kind == 0, "Favorevole").when(kind == 1, " contrario ").when(kind == 2, "ASTENSIONE").when(kind == 3, "Ha votato")
        .when(kind.isin(4, 5), "Non ha votato").otherwise("sconosciuto")
    )
    reason = F.when(kind == 4, F.when(why == 0, "Non ha votato").when(why == 1, "Non ha partecipato").when(why == 2, " In missione")
                    .when(why == 3, "Presidente di turno").otherwise("altro"))
    return d.table("lineitem").select(
        "l_orderkey", "l_linenumber", V.decode_expression(said, reason).alias("expression")
    )


@query("lower_ballots", """
    SELECT 'vs19_' || o_orderkey::varchar AS ext_id, o_orderdate::date AS ballot_date, nullif(trim(o_orderpriority), '') AS kind,
           CASE WHEN o_orderkey % 4 = 0 THEN 'C.' || o_orderkey::varchar WHEN o_orderkey % 4 = 1 THEN 'C.' || (o_orderkey + 7)::varchar END AS act_ref,
           CASE WHEN o_orderkey % 3 = 0 THEN 'Misure "' || o_orderpriority || '"' END AS act_title, o_orderkey % 3 = 0 AS is_final,
           (o_orderkey % 100)::int AS n_for, (o_custkey % 100)::int AS n_against,
           CASE o_orderstatus WHEN 'O' THEN NULL ELSE o_orderstatus = 'F' END AS approved FROM orders""")
def lower_ballots(d):
    key = F.col("o_orderkey")
    rows = d.table("orders").select(_map(
        v=F.concat(F.lit("http://dati.example/votazione.rdf/vs19_"), key.cast("string")),
        data=F.date_format("o_orderdate", "yyyyMMdd"), tipo=F.concat(F.lit("  "), F.col("o_orderpriority")),
        titolo=F.lit(" "), descr=F.when(key % 4 == 1, F.concat(F.lit("pdl "), (key + 7).cast("string"), F.lit(" - voto finale"))),
        atto=F.when(key % 4 == 0, F.concat(F.lit("http://dati.example/attocamera.rdf/ac19_"), key.cast("string"))),
        atto_titolo=F.when(key % 3 == 0, F.concat(F.lit("Misure  &amp;quot;"), F.col("o_orderpriority"), F.lit(
            "&amp;quot;<em></em>^^http://www.w3.org/2001/XMLSchema#string"))),
        finale=F.when(key % 3 == 0, "1").otherwise("0"), fav=key % 100, con=F.col("o_custkey") % 100, ast=F.lit(0),
        approvato=F.when(F.col("o_orderstatus") == "F", "true").when(F.col("o_orderstatus") == "P", "0"),
    ).alias("row"))
    return CH.lower_ballots(rows, 19).select(
        "ext_id", "ballot_date", "kind", "act_ref", "act_title", "is_final", "n_for", "n_against", "approved"
    )


@query("act_choice", """
    WITH docs AS (
      SELECT DISTINCT ON (o_custkey, ddl) o_custkey, ddl, phase, state, title FROM (
        SELECT o_custkey, o_orderkey, 'd' || (o_orderkey % 9)::varchar AS ddl,
               CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'S.' || (o_orderkey % 50)::varchar END AS phase,
               CASE WHEN o_orderkey % 3 = 0 THEN 'assorbito' ELSE 'approvato' END AS state, 'Legge ' || (o_orderkey % 7)::varchar AS title
        FROM orders) ORDER BY o_custkey, ddl, o_orderkey),
    phased AS (SELECT *, bool_or(phase <> '') OVER (PARTITION BY o_custkey) AS has_phase FROM docs),
    voices AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, count(*) FILTER (state <> 'assorbito') OVER (PARTITION BY o_custkey) AS alive
               FROM phased WHERE NOT has_phase OR phase <> ''),
    remaining AS (SELECT * FROM voices WHERE n = 1 OR alive = 0 OR state <> 'assorbito'),
    counted AS (SELECT o_custkey, count(*) AS n, min(nullif(phase, '')) AS phase, min(title) AS title FROM remaining GROUP BY 1),
    refs AS (SELECT o_custkey, string_agg(phase, ', ' ORDER BY num, phase) AS phases FROM (
               SELECT DISTINCT o_custkey, phase, coalesce(try_cast(regexp_extract(phase, '[0-9]+') AS int), 0) AS num FROM remaining) GROUP BY 1)
    SELECT o_custkey, CASE WHEN n > 1 THEN phases ELSE phase END AS act_ref, CASE WHEN n = 1 THEN title END AS act_title
    FROM counted JOIN refs USING (o_custkey)""")
def act_choice(d):
    key = F.col("o_orderkey")
    rows = d.table("orders").select(
        "o_custkey", key.alias("ord"), F.concat(F.lit("d"), (key % 9).cast("string")).alias("ddl"),
        F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("S."), (key % 50).cast("string"))).alias("phase"),
        F.when(key % 3 == 0, "assorbito").otherwise("approvato").alias("state"),
        F.concat(F.lit("Legge "), (key % 7).cast("string")).alias("title"),
    )
    return CH.chosen_acts(rows, ["o_custkey"])


@query("group_labels", """
    SELECT n_nationkey, n_name AS name, 'N' || n_nationkey::varchar || ' (X)' AS acronym, date '1996-05-09' AS valid_from
    FROM nation WHERE n_nationkey % 4 <> 0""")
def group_labels(d):
    number = F.col("n_nationkey").cast("string")
    good = F.concat(F.col("n_name"), F.lit(" (N"), number, F.lit(" (X)) (09.05.1996-)"))
    labels = d.table("nation").select(
        "n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).otherwise(good).alias("label")
    )
    parsed = CH.group_labels(labels)
    return parsed.join(labels, "label").select("n_nationkey", "name", "acronym", "valid_from")


@query("monthly_windows", """
    WITH span AS (SELECT min(l_shipdate)::date AS a, max(l_shipdate)::date AS b FROM lineitem),
    months AS (SELECT a, b, unnest(generate_series(date_trunc('month', a)::timestamp, b::timestamp, interval 1 month))::date AS m FROM span)
    SELECT greatest(a, m) AS window_from, least(b, last_day(m)) AS window_to FROM months""")
def monthly_windows(d):
    day = F.to_date("l_shipdate")
    return B.monthly_windows(d.table("lineitem").agg(F.min(day).alias("span_from"), F.max(day).alias("span_to")))


@query("source_profile", """
    SELECT event_type, count(*) AS n, min(props) AS sample FROM events GROUP BY 1""")
def source_profile(d):
    return B.class_profile(d.table("events"), "event_type", "props")


@query("source_extent", """
    SELECT min(ts)::date AS first_day, max(ts)::date AS last_day, count(*) AS n_rows, count(DISTINCT user_id) AS n_distinct FROM events""")
def source_extent(d):
    return B.extent(d.table("events").withColumn("day", F.to_date("ts")), "day", "user_id")


@query("first_occurrence", """
    SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, min(page_id) AS page_id FROM pages GROUP BY 1""")
def first_occurrence(d):
    hosts = TX.elements(d).select(F.col("source").alias("host"), F.col("ord").alias("page_id"))
    return T.newest(hosts, ["host"], [F.col("page_id")])


@query("component_memberships", """
    SELECT o_custkey::varchar AS person_ext_id, 'p' || (c_nationkey % 3)::varchar AS party_id, o_orderdate::date AS valid_from,
           max((o_orderdate + interval 30 day)::date) AS valid_to
    FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 20 AND c_nationkey % 4 <> 0 GROUP BY 1, 2, 3""")
def component_memberships(d):
    joined = d.table("orders").join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    day = F.to_date("o_orderdate")
    rows = joined.select(
        F.col("c_nationkey").alias("component"), F.col("o_custkey").cast("string").alias("person_ext_id"),
        day.alias("valid_from"), F.date_add(day, 30).alias("valid_to"),
    )
    nation = F.col("n_nationkey")
    mapping = d.table("nation").filter(nation < 20).select(
        nation.alias("component"), F.when(nation % 4 != 0, F.concat(F.lit("p"), (nation % 3).cast("string"))).alias("party_id")
    )
    return CH.component_memberships(rows, mapping)[0]


# ---- quality --------------------------------------------------------------------------------------------------------


@query("duplicate_factor", """
    SELECT count(*) AS n_rows, count(DISTINCT (ballot_id, person_id)) AS n_distinct,
           floor(100 * count(*) / count(DISTINCT (ballot_id, person_id)))::bigint AS per_key_hundredths FROM vote_rows""")
def duplicate_factor(d):
    return Q.duplicate_factor(d.shared("vote_rows"), ["ballot_id", "person_id"])


@query("orphan_groups", """
    SELECT group_id, count(*) AS n_ballots FROM group_counts c WHERE group_id IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM group_party g WHERE g.group_id = c.group_id) GROUP BY 1""")
def orphan_groups(d):
    return Q.groups_without_party(d.group_counts, d.shared("group_party"))


@query("votes_outside_membership", """
    SELECT person_id, count(*) AS n_votes FROM votes v WHERE NOT EXISTS (SELECT 1 FROM group_periods p
      WHERE p.person_id = v.person_id AND v.on_date >= p.valid_from AND (p.valid_to IS NULL OR v.on_date <= p.valid_to)) GROUP BY 1""")
def votes_outside_membership(d):
    return Q.votes_outside_membership(d.votes, d.shared("memberships"))


@query("dq_periods", """
    SELECT 'period_order' AS "check", o_orderkey::varchar AS key, (o_orderdate::date - (o_orderkey % 3)::int)::varchar AS detail
    FROM orders WHERE o_orderkey % 3 <> 0""")
def dq_periods(d):
    day = F.to_date("o_orderdate")
    periods = d.table("orders").select(
        "o_orderkey", day.alias("valid_from"), F.date_sub(day, (F.col("o_orderkey") % 3).cast("int")).alias("valid_to")
    )
    return Q.period_order(periods, ["o_orderkey"])


@query("dq_duplicates", """
    SELECT 'duplicate_key' AS "check", ballot_id::varchar || '|' || person_id::varchar AS key, count(*)::varchar AS detail
    FROM vote_rows GROUP BY ballot_id, person_id HAVING count(*) > 1""")
def dq_duplicates(d):
    return Q.duplicate_keys(d.shared("vote_rows"), ["ballot_id", "person_id"])


@query("dq_domains", """
    SELECT 'domain_event_type' AS "check", event_id::varchar AS key, event_type AS detail FROM events WHERE event_type IN ('error', 'signup')
    UNION ALL SELECT 'negative_count', c_custkey::varchar, floor(c_acctbal)::bigint::varchar FROM customer WHERE floor(c_acctbal) < 0""")
def dq_domains(d):
    kinds = Q.outside_domain(d.table("events"), "event_type", ["view", "click", "purchase"], ["event_id"])
    money = d.table("customer").select("c_custkey", F.floor("c_acctbal").alias("balance"), F.lit(0).alias("other"))
    return kinds.unionByName(Q.negative(money, ["balance", "other"], ["c_custkey"]))


@query("dq_nullability", f"""
    WITH {RU.POSITIONS_SQL},
    spoiled AS (SELECT subject_id, statement_id, value, CASE WHEN statement_id = 's3' THEN 'documented' ELSE status END AS status,
                       CASE WHEN statement_id = 's5' THEN NULL ELSE confidence END AS confidence FROM positions)
    SELECT 'value_vs_status' AS "check", subject_id || '|' || statement_id AS key, status AS detail FROM spoiled
    WHERE (value IS NULL) <> (status = 'not_documented')
    UNION ALL SELECT 'value_vs_confidence', subject_id || '|' || statement_id, coalesce(confidence, 'NULL') FROM spoiled
    WHERE (value IS NULL) <> (confidence IS NULL)""")
def dq_nullability(d):
    spoiled = RU.positions(d).withColumn(
        "status", F.when(F.col("statement_id") == "s3", "documented").otherwise(F.col("status"))
    ).withColumn("confidence", F.when(F.col("statement_id") != "s5", F.col("confidence")))
    return Q.position_nullability(spoiled)


@query("dq_membership_targets", """
    SELECT 'membership_target' AS "check", person_id::varchar || '|' || kind AS key, kind AS detail
    FROM memberships WHERE kind = 'group' AND person_id % 50 = 0""")
def dq_membership_targets(d):
    spoiled = d.shared("memberships").withColumn(
        "party_id", F.when((F.col("kind") == "group") & (F.col("person_id") % 50 == 0), 1).otherwise(F.col("party_id"))
    )
    return Q.membership_targets(spoiled, ["person_id"])


@query("dq_orphans", """
    SELECT 'unknown_person' AS "check", person_id::varchar AS key, count(*)::varchar AS detail FROM votes v
    WHERE NOT EXISTS (SELECT 1 FROM persons p WHERE p.person_id = v.person_id) GROUP BY person_id""")
def dq_orphans(d):
    return Q.orphans(d.votes, d.shared("persons"), ["person_id"], "unknown_person")


@query("dq_retention", """
    SELECT 'text_without_expiry' AS "check", doc_id::varchar AS key, 'C' AS detail FROM documents WHERE doc_id % 3 = 2 AND doc_id % 5 = 0
    UNION ALL SELECT 'cleared_text_present', doc_id::varchar, '2024-02-01 00:00:00' FROM documents WHERE doc_id % 7 = 0""")
def dq_retention(d):
    key = F.col("doc_id")
    moment = F.expr(TX.NOW)
    held = d.table("documents").select(
        "doc_id", "text", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (key % 3 + 1).cast("int")).alias("level"),
        F.when(key % 5 != 0, moment).alias("text_expires_at"), F.when(key % 7 == 0, moment).alias("text_cleared_at"),
    )
    return Q.retention_rules(held, ["doc_id"])


@query("dq_source_rules", """
    WITH s AS (SELECT url, page_id::varchar AS source, CASE page_id % 4 WHEN 0 THEN 'outlet' WHEN 1 THEN 'agency' WHEN 2 THEN 'party' ELSE 'politician' END AS kind,
        CASE page_id % 3 WHEN 0 THEN 'site' WHEN 1 THEN 'preview' ELSE 'rss' END AS channel, CASE WHEN page_id % 5 < 3 THEN 'C' ELSE 'A' END AS level,
        CASE WHEN page_id % 2 = 0 THEN '/x' END AS link_pattern, CASE WHEN page_id % 7 < 5 THEN 'left' END AS orientation,
        CASE WHEN page_id % 6 = 2 THEN 'p' END AS party FROM pages)
    SELECT 'site_needs_link' AS "check", source AS key, kind AS detail FROM s WHERE channel = 'site' AND link_pattern IS NULL
    UNION ALL SELECT 'preview_address', source, kind FROM s WHERE channel = 'preview'
    UNION ALL SELECT 'orientation_iff_press', source, kind FROM s WHERE (kind IN ('outlet', 'agency')) <> (orientation IS NOT NULL)
    UNION ALL SELECT 'level_c_iff_press', source, kind FROM s WHERE (kind IN ('outlet', 'agency')) <> (level = 'C')
    UNION ALL SELECT 'party_missing', source, kind FROM s WHERE kind = 'party' AND party IS NULL
    UNION ALL SELECT 'person_missing', source, kind FROM s WHERE kind = 'politician'""")
def dq_source_rules(d):
    key = F.col("page_id")
    kinds = F.array(*[F.lit(x) for x in ("outlet", "agency", "party", "politician")])
    channels = F.array(*[F.lit(x) for x in ("site", "preview", "rss")])
    sources = d.table("pages").select(
        key.cast("string").alias("source"), "url", F.element_at(kinds, (key % 4 + 1).cast("int")).alias("kind"),
        F.element_at(channels, (key % 3 + 1).cast("int")).alias("channel"), F.when(key % 5 < 3, "C").otherwise("A").alias("level"),
        F.when(key % 2 == 0, "/x").alias("link_pattern"), F.when(key % 7 < 5, "left").alias("orientation"),
        F.when(key % 6 == 2, "p").alias("party"), F.lit(None).cast("string").alias("person"),
    )
    return Q.source_rules(sources)


@query("dq_themes", f"""
    WITH {RU.DRAFTS_SQL}, counts AS (SELECT theme, count(*) AS n FROM drafts WHERE length(text) > 12 GROUP BY 1)
    SELECT 'themes_unequal' AS "check", theme AS key, n::varchar AS detail FROM counts
    WHERE (SELECT max(n) > min(n) FROM counts)""")
def dq_themes(d):
    rows = RU.drafts(d).withColumn("status", F.when(F.length("text") > 12, "active").otherwise("draft"))
    return Q.unequal_themes(rows)


@query("dq_forms", """
    SELECT 'form_of_two_people' AS "check", form AS key, a || ',' || b AS detail FROM (
      SELECT lower(p_name) AS form, min(p_brand) AS a, max(p_brand) AS b FROM part GROUP BY 1) WHERE a <> b""")
def dq_forms(d):
    return Q.shared_forms(d.table("part").select(F.col("p_name").alias("form"), F.col("p_brand").alias("slug")))


@query("dq_outlet_balance", """
    WITH o AS (SELECT x.orientation, count(doc_id) AS n FROM (VALUES ('en'), ('fr'), ('de'), ('it')) x(orientation)
               LEFT JOIN documents ON lang = x.orientation AND doc_id % 4 <> 3 GROUP BY 1)
    SELECT 'outlet_balance' AS "check", orientation AS key, n::varchar AS detail FROM o
    WHERE (SELECT max(n) <> min(n) OR min(n) = 0 FROM o)""")
def dq_outlet_balance(d):
    rows = d.table("documents").select(
        F.lit("outlet").alias("kind"), F.col("lang").alias("orientation"), (F.col("doc_id") % 4 != 3).alias("active")
    )
    return Q.outlet_balance(rows, ["en", "fr", "de", "it"])


@query("dq_bundle", f"""
    WITH {RE.TREND_SQL}, {RU.SEATS_SQL},
    spoiled AS (SELECT party_id, quarter, metric, CASE WHEN quarter(quarter) = 2 THEN n + 1000 ELSE n END AS n, d FROM series
                WHERE NOT (party_id = 3 AND quarter(quarter) = 4)),
    lengths AS (SELECT party_id, metric, count(*) AS len FROM spoiled GROUP BY 1, 2)
    SELECT 'n_over_d' AS "check", party_id::varchar || '|' || metric || '|' || quarter::varchar AS key, n::varchar AS detail
    FROM spoiled WHERE n > d
    UNION ALL SELECT 'series_length', party_id::varchar || '|' || metric, len::varchar FROM lengths
    WHERE len <> (SELECT count(DISTINCT quarter) FROM spoiled)
    UNION ALL SELECT 'seats_vs_total', chamber, (sum(seats) FILTER (holder <> 'total') - sum(seats) FILTER (holder = 'total'))::bigint::varchar
    FROM (SELECT chamber, holder, seats + CASE WHEN chamber = 'upper' AND holder = 'others' THEN 2 ELSE 0 END AS seats FROM seat_counts) s
    GROUP BY chamber HAVING sum(seats) FILTER (holder <> 'total') <> sum(seats) FILTER (holder = 'total')""")
def dq_bundle(d):
    quarter = F.quarter("quarter")
    series = RE.trend(d).filter(~((F.col("party_id") == 3) & (quarter == 4))).withColumn(
        "n", F.when(quarter == 2, F.col("n") + 1000).otherwise(F.col("n"))
    )
    extra = F.when((F.col("chamber") == "upper") & (F.col("holder") == "others"), 2).otherwise(0)
    return Q.series_shape(series).unionByName(Q.seat_sums(RU.seats(d).withColumn("seats", F.col("seats") + extra)))


@query("import_gate", """
    SELECT count(*) AS ballots, count(*) FILTER (NOT coherent) AS incoherent, greatest(10, floor(count(*) / 100))::bigint AS tolerated,
           count(*) FILTER (NOT coherent) > greatest(10, floor(count(*) / 100)) AS failed FROM ballots""")
def import_gate(d):
    return Q.import_gate(V.coherence(d.ballots, V.ballot_totals(d.group_counts)))


# ---- sinks ----------------------------------------------------------------------------------------------------------


@query("insert_if_absent", """
    SELECT user_id, date_trunc('day', ts)::date AS day, min_by(event_id, (event_type <> 'view', event_id)) AS event_id
    FROM events GROUP BY 1, 2""")
def insert_if_absent(d):
    """A user's first view of each day, or else the day's first event: all views are appended, then all events, twice. Each key
    stays as it was first stored."""
    events = d.table("events").select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type")
    table = KeyedTable(d.spark, fresh_folder(d.spark, "keyed"), "user_id long, day date, event_id long", ["user_id", "day"])
    for rows in (events.filter("event_type = 'view'"), events, events):
        table.append(rows, [F.col("event_id")])
    return table.read()


LEDGER = {
    "ballots": "ballot_id date, chamber string, term int, ext_id string, n_for long, n_against long, n_abstain long, coherent boolean",
    "counts": "ballot_id date, group_id int, n_for long, n_against long, n_abstain long, n_other long",
    "kept": "ballot_id date, person_id long, group_id int, expression string",
    "unattributed": "ballot_id date, person_id long, reason string",
}


@query("ballot_import", """
    WITH kept AS (
      SELECT v.* FROM grouped_votes v JOIN persons p ON p.person_id = v.person_id WHERE p.slug LIKE 'person-%'
        OR (SELECT count(*) FROM group_party g WHERE g.group_id = v.group_id AND v.on_date >= g.valid_from AND (g.valid_to IS NULL OR v.on_date <= g.valid_to)) > 1),
    lost AS (SELECT v.* FROM votes v WHERE NOT EXISTS (SELECT 1 FROM persons p WHERE p.person_id = v.person_id))
    SELECT 'ballots' AS stored, ballot_id, count(*) AS n, sum(n_for + n_against + n_abstain)::bigint AS total, bool_and(coherent) AS coherent FROM ballots GROUP BY 2
    UNION ALL SELECT 'counts', ballot_id, count(*), sum(n_for + n_against + n_abstain + n_other)::bigint, NULL FROM group_counts GROUP BY 2
    UNION ALL SELECT 'kept', ballot_id, count(*), sum(coalesce(group_id, 0) + person_id)::bigint, NULL FROM kept GROUP BY 2
    UNION ALL SELECT 'unattributed', ballot_id, count(*), sum(person_id)::bigint, NULL FROM lost GROUP BY 2""")
def ballot_import(d):
    """All ballots, a term a block. The first block fails after two of its tables and is imported again; then everything once
    more. What readers find is counted per table and ballot."""
    ledger = Ledger(d.spark, fresh_folder(d.spark, "ledger"), LEDGER)
    d.votes = written(d.votes, "votes")
    ballots = written(d.ballots, "declared")
    given = d.votes, d.shared("memberships"), d.shared("persons"), d.shared("group_party")
    begun, version = IM.block_tables(ledger, ballots.filter("term = 18"), *given), ledger.begin()
    for name in ("counts", "kept"):  # a writer that got no further
        ledger.stage(version, name, begun[name]())
    for block, rows in (("18", ballots.filter("term = 18")), ("19", ballots.filter("term = 19")), ("all", ballots)):
        IM.import_block(ledger, block, rows, *given)

    def told(name, total, coherent):
        return ledger.read(name).groupBy("ballot_id").agg(F.count(F.lit(1)).alias("n"), F.sum(total).alias("total"), coherent.alias("coherent")).select(F.lit(name).alias("stored"), "*")

    sides, none = F.col("n_for") + F.col("n_against") + F.col("n_abstain"), F.first(F.lit(None).cast("boolean"))
    return (
        told("ballots", sides, F.bool_and("coherent")).unionByName(told("counts", sides + F.col("n_other"), none))
        .unionByName(told("kept", F.coalesce("group_id", F.lit(0)) + F.col("person_id"), none)).unionByName(told("unattributed", F.col("person_id"), none))
    )


@query("reread_documents", """
    WITH stored AS (SELECT sha256(text) AS sha256, max(1 + doc_id % 3) AS v FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1)
    SELECT doc_id, sha256(text) AS sha256 FROM documents LEFT JOIN stored s ON s.sha256 = sha256(text) WHERE coalesce(v, 0) < 3""")
def reread_documents(d):
    listed = d.table("documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    stored = listed.filter("doc_id % 4 <> 0").select("sha256", (1 + F.col("doc_id") % 3).alias("extraction"))
    return sinks.documents_to_reread(stored, listed, 3).select("doc_id", "sha256")


@query("inputs_to_process", """
    WITH done AS (SELECT DISTINCT sha256(text) AS input_sha FROM documents WHERE doc_id % 6 = 0)
    SELECT DISTINCT sha256(text) AS input_sha FROM documents WHERE sha256(text) NOT IN (SELECT input_sha FROM done)""")
def inputs_to_process(d):
    batches = d.table("documents").select(F.sha2("text", 256).alias("input_sha"), "doc_id")
    done = batches.select(
        "input_sha", F.when(F.col("doc_id") % 2 == 0, "m1").otherwise("m2").alias("model"),
        F.when(F.col("doc_id") % 3 == 0, "p1").otherwise("p2").alias("prompt"),
    )
    return sinks.inputs_to_process(batches, done, "m1", "p1").select("input_sha")


@query("reused_answers", """
    WITH done AS (SELECT sha256(text) AS input_sha, min(lang) AS answer FROM documents WHERE doc_id % 6 = 0 GROUP BY 1)
    SELECT doc_id, answer FROM documents JOIN done ON input_sha = sha256(text)""")
def reused_answers(d):
    docs = d.table("documents").select(F.sha2("text", 256).alias("input_sha"), "doc_id", "lang")
    done = docs.filter("doc_id % 6 = 0").select(
        "input_sha", F.lit("m1").alias("model"), F.lit("p1").alias("prompt"), F.col("lang").alias("answer")
    )
    return sinks.reused_answers(docs.drop("lang"), done, "m1", "p1").select("doc_id", "answer")
