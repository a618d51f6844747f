"""Queries on claims, promises, identities and functions called from SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions.catalog import register_party_at_date
from tallyframe import sinks
from tallyframe.operators import asof as A
from tallyframe.operators import bundle as BU
from tallyframe.operators import identity as ID
from tallyframe.operators import positions as P
from tallyframe.operators import votes as V
from tallyframe.plans import published as PB
from tallyframe.plans import record as RE
from tallyframe.plans import rules as RU
from tallyframe.plans import texts as TX
from tallyframe.plans.registry import QUERIES, query
from tallyframe.storage import fresh_folder, written


@query("party_at_date_sql", None)
def party_at_date_sql(d):
    """The votes with the party that a function called from SQL gives."""
    register_party_at_date(d.spark, d.shared("group_party"), d.shared("memberships"))
    votes = d.votes.select("ballot_id", "on_date", "person_id", "group_id")
    return d.spark.sql("SELECT ballot_id, person_id, group_id, party_at_date(person_id, group_id, on_date) AS party_id FROM {votes}", votes=votes)


QUERIES["party_at_date_sql"] = type(QUERIES["party_at_date_sql"])(party_at_date_sql, QUERIES["party_at_date"].oracle)


# An observation is a priority's largest order of a day; a claim is an event that declares a level or a change.
CLAIMS = """
    SELECT event_id AS claim_id, CASE event_id % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '4-NOT SPECIFIED'
             WHEN 4 THEN '5-LOW' ELSE 'none' END AS series,
           CASE WHEN event_id % 4 = 0 THEN 'change' ELSE 'level' END AS kind,
           date_add(date '1992-01-01', cast(event_id * 37 % 2300 - 20 as int)) AS since,
           date_add(date '1992-01-01', cast(event_id * 37 % 2300 - 20 + event_id % 300 as int)) AS until,
           CASE event_id % 7 WHEN 0 THEN 'thousand' WHEN 1 THEN 'percent' ELSE 'one' END AS unit,
           cast(CASE WHEN event_id % 7 = 0 THEN 130 + event_id % 90 ELSE (130 + event_id % 90) * 1000 END as decimal(18,4)) AS declared
    FROM {events}"""
TOLERANCES = {A.LEVEL: A.Tolerance("0.1000", "5000"), A.CHANGE: A.Tolerance("0.2000")}


@query("claims_against_series", f"""
    WITH claims AS ({CLAIMS.format(events="events").replace("date_add(date '1992-01-01', cast(", "(date '1992-01-01' + cast(")}),
    obs AS (SELECT o_orderpriority AS series, cast(o_orderdate as date) AS on_date, max(o_totalprice)::decimal(18,4) AS v FROM orders GROUP BY 1, 2),
    asked AS (
      SELECT c.*, (SELECT max_by(v, on_date) FROM obs o WHERE o.series = c.series AND o.on_date <= c.until) AS e,
        (SELECT max_by(v, on_date) FROM obs o WHERE o.series = c.series AND o.on_date <= c.since) AS s FROM claims c),
    valued AS (SELECT *, CASE WHEN kind = 'level' THEN e ELSE e - s END::decimal(18,4) AS official,
        CASE unit WHEN 'thousand' THEN declared * 1000 WHEN 'one' THEN declared END::decimal(18,4) AS own FROM asked),
    judged AS (SELECT *, CASE WHEN official IS NULL THEN 'series_missing' WHEN own IS NULL THEN 'unit_mismatch'
        WHEN official <> 0 AND abs(own - official) <= CASE kind WHEN 'level' THEN 0.1 ELSE 0.2 END * abs(official) THEN 'within'
        WHEN kind = 'level' AND abs(own - official) <= 5000 THEN 'within'
        WHEN official <> 0 AND abs(own - official) <= CASE kind WHEN 'level' THEN 0.2 ELSE 0.4 END * abs(official) THEN 'within_double'
        ELSE 'beyond' END AS rule FROM valued)
    SELECT claim_id, series, official::double AS official, rule, CASE rule WHEN 'series_missing' THEN 'unverifiable' WHEN 'unit_mismatch' THEN 'unverifiable'
      WHEN 'within' THEN 'supported' WHEN 'within_double' THEN 'imprecise' ELSE 'contradicted' END AS outcome FROM judged""")
def claims_against_series(d):
    claims = d.spark.sql(CLAIMS, events=d.table("events"))
    seen = d.table("orders").groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("on_date")).agg(F.max("o_totalprice").alias("value"))
    names = d.table("orders").select(F.col("o_orderpriority").alias("series")).distinct()
    units = names.select("series", F.explode(F.create_map(F.lit("one"), F.lit("1"), F.lit("thousand"), F.lit("1000"))).alias("unit", "factor"))
    units = units.unionByName(d.spark.range(1).select(F.lit("none").alias("series"), F.lit("one").alias("unit"), F.lit("1").alias("factor")))
    found = A.judged_claims(claims, seen, units, TOLERANCES)
    return found.select("claim_id", "series", F.col("official").cast("double").alias("official"), "rule", "outcome")


# Promises are lines of documents; the acts are the final ballots on their topics.
@query("promise_status", f"""
    WITH {TX.PROMISES_SQL},
    made AS (SELECT promise_id, (document_id % 5)::int AS party_id, theme AS topic, date '1993-01-01' + ((document_id * 53 + n * 7) % 1500)::int AS made_on,
        date '1993-01-01' + ((document_id * 53 + n * 7) % 1500 + 40 + document_id % 100)::int AS until, (document_id + n) % 7 <> 0 AS agreed FROM promises),
    acts AS (SELECT ballot_id AS act_id, ballot_date AS act_date, 't' || (seq % 6)::varchar AS topic, coalesce(approved, false) AS approved, seq % 4 = 0 AS partial
        FROM ballot_facts WHERE is_final),
    found AS (SELECT m.*,
        (SELECT min(act_date) FROM acts a WHERE a.topic = m.topic AND approved AND NOT partial AND act_date BETWEEN made_on AND until) AS w,
        (SELECT min(act_date) FROM acts a WHERE a.topic = m.topic AND approved AND partial AND act_date BETWEEN made_on AND until) AS p FROM made m),
    decided AS (SELECT f.*, coalesce(w, p) AS act, coalesce(v.n_against > v.n_for, false) AS against
        FROM found f LEFT JOIN party_votes v ON v.ballot_id = coalesce(w, p) AND v.party_id = f.party_id)
    SELECT promise_id, CASE WHEN NOT agreed THEN 'to_verify' WHEN act IS NULL OR against THEN 'not_kept' WHEN w IS NULL THEN 'halfway' ELSE 'kept' END AS status,
      CASE WHEN agreed THEN act END AS act_date FROM decided""")
def promise_status(d):
    since = F.date_add(F.lit("1993-01-01").cast("date"), ((F.col("document_id") * 53 + F.col("n") * 7) % 1500).cast("int"))
    made = TX.promises(d).select(
        "promise_id", (F.col("document_id") % 5).cast("int").alias("party_id"), F.col("theme").alias("topic"), since.alias("made_on"),
        F.date_add(since, (40 + F.col("document_id") % 100).cast("int")).alias("until"), ((F.col("document_id") + F.col("n")) % 7 != 0).alias("agreed"),
    )
    acts = d.shared("ballot_facts").filter("is_final").select(
        F.concat(F.lit("t"), (F.col("seq") % 6).cast("string")).alias("topic"), F.col("ballot_id").alias("act_id"), F.col("ballot_date").alias("act_date"),
        F.coalesce("approved", F.lit(False)).alias("approved"), (F.col("seq") % 4 == 0).alias("partial"),
    )
    votes = V.party_counts(d.dated_counts, d.shared("group_party"))
    votes = votes.select(F.col("ballot_id").alias("act_id"), "party_id", (F.col("n_against") > F.col("n_for")).alias("against"))
    return A.promise_status(made, acts, votes).select("promise_id", "status", "act_date")


# A name is borne by several customers; each of them is an identity with the periods of its memberships.
@query("two_identities", """
    WITH named AS (SELECT person_id % 300 AS name, person_id, valid_from, coalesce(valid_to, date '2000-12-31') AS valid_to FROM memberships
                   WHERE kind = 'party' OR person_id % 5 = 0),
    days AS (SELECT name, day::date AS day, count(DISTINCT person_id) AS n
             FROM (SELECT name, person_id, unnest(generate_series(valid_from, valid_to, interval 1 day)) AS day FROM named) GROUP BY 1, 2 HAVING n >= 2),
    runs AS (SELECT *, day - row_number() OVER (PARTITION BY name, n ORDER BY day)::int AS g FROM days)
    SELECT name, min(day) AS valid_from, max(day) AS valid_to, n::int AS identities FROM runs GROUP BY name, n, g""")
def two_identities(d):
    rows = d.shared("memberships").filter("kind = 'party' OR person_id % 5 = 0").withColumn("name", F.col("person_id") % 300)
    return ID.simultaneous(rows, "name", "person_id", "2000-12-31")


@query("linked_identities", """
    WITH RECURSIVE ids AS (SELECT c_custkey AS identity, c_custkey * 31 % 700 AS form, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 90 END AS code FROM customer),
    ties AS (SELECT DISTINCT a.identity AS a, b.identity AS b FROM ids a JOIN ids b ON a.form = b.form OR a.code = b.code),
    reach AS (SELECT identity AS a, identity AS b FROM ids UNION SELECT r.a, t.b FROM reach r JOIN ties t ON t.a = r.b)
    SELECT a AS identity, min(b) AS person FROM reach GROUP BY 1""")
def linked_identities(d):
    key = F.col("c_custkey")
    ids = d.table("customer").select(key.alias("identity"), (key * 31 % 700).alias("form"), F.when(key % 3 == 0, key % 90).alias("code"))
    return ID.linked_identities(ids, "identity", ["form", "code"])


@query("votes_outside_membership", """
    SELECT ballot_id, person_id, expression FROM votes v WHERE NOT EXISTS (SELECT 1 FROM memberships m WHERE m.kind = 'group' AND m.person_id = v.person_id
      AND v.on_date >= m.valid_from AND (m.valid_to IS NULL OR v.on_date <= m.valid_to))""")
def votes_outside_membership(d):
    return ID.votes_outside_membership(d.votes, d.shared("memberships")).select("ballot_id", "person_id", "expression")


# ---- a whole release ------------------------------------------------------------------------------------------------


def sections(d):
    """All sections of a release from the tables; the votes are counted once for the four that start from them."""
    party = lambda c: F.concat(F.lit("party-"), c.cast("string"))
    people = V.tracked_people(d.shared("persons")).select(F.col("slug").alias("id"), F.lit("person").alias("kind"), party(F.col("person_id") % 5).alias("party_id"))
    parties = d.table("region").select(party(F.col("r_regionkey")).alias("id"), F.lit("party").alias("kind"), F.lit(None).cast("string").alias("party_id"))
    metrics = TX.programme_metrics(d)
    return {
        "subjects": parties.unionByName(people),
        "questions": d.shared("statements").select(F.col("statement_id").alias("id"), "theme", F.col("ballot_date").alias("date"), "chamber"),
        "positions": P.position_of(RU.evidence(d)),
        "series": RE.trend(d).withColumn("party_id", party(F.col("party_id"))),
        "seats": RU.seats(d),
        "programmes": metrics.withColumn("party_id", party(F.col("document_id") % 5)),
        "corrections": PB.corrections(d),
    }


BUNDLE_SQL = f"""
{RU.POSITIONS_SQL}, {RE.TREND_SQL}, {RU.SEATS_SQL}, {TX.PROMISES_SQL},
subjects AS (SELECT 'party-' || r_regionkey::varchar AS id, 'party' AS kind, NULL::varchar AS party_id FROM region
  UNION ALL SELECT slug, 'person', 'party-' || (person_id % 5)::varchar FROM persons WHERE slug LIKE 'person-%'),
metrics AS (SELECT DISTINCT party_id AS filed_by, 'party-' || (document_id % 5)::varchar AS party_id, document_id, coalesce(promises, 0) AS promises, coalesce(precise, 0) AS precise
  FROM programmes LEFT JOIN (SELECT document_id, count(*) AS promises, count(*) FILTER (precise) AS precise FROM precise GROUP BY 1) USING (document_id)
  WHERE election = (SELECT max(election) FROM programmes))"""


@query("release", f"""
    WITH {BUNDLE_SQL}
    SELECT 'subjects' AS section, count(*) AS n_rows, '2024.1' AS version FROM subjects UNION ALL SELECT 'questions', count(*), '2024.1' FROM statements
    UNION ALL SELECT 'positions', count(*), '2024.1' FROM positions WHERE status <> 'not_documented' UNION ALL SELECT 'series', count(*), '2024.1' FROM series
    UNION ALL SELECT 'seats', count(*), '2024.1' FROM seat_counts UNION ALL SELECT 'programmes', count(*), '2024.1' FROM metrics
    UNION ALL SELECT 'corrections', count(*), '2024.1' FROM events""")
def release(d):
    """The manifest of a release made of all sections, without its fingerprints (see `manifest`)."""
    made = BU.publish(sections(d), fresh_folder(d.spark, "release"), "2024.1", {"positions": True}, TX.PROGRAMME_THEMES)
    return made.select("section", "n_rows", "version")


@query("release_violations", f"""
    WITH {BUNDLE_SQL},
    left_ AS (SELECT * FROM subjects WHERE id NOT IN ('party-3', 'person-11') UNION ALL SELECT * FROM subjects WHERE id = 'person-22')
    SELECT 'repeated_subject' AS "check", id AS key, count(*)::varchar AS detail FROM left_ GROUP BY id HAVING count(*) > 1
    UNION ALL SELECT 'party_of_subject', party_id, count(*)::varchar FROM left_ WHERE party_id IS NOT NULL AND party_id NOT IN (SELECT id FROM left_) GROUP BY 2
    UNION ALL SELECT 'subject_of_position', subject_id, count(*)::varchar FROM positions WHERE status <> 'not_documented' AND subject_id NOT IN (SELECT id FROM left_) GROUP BY 2
    UNION ALL SELECT 'party_of_series', 'party-' || party_id::varchar, count(*)::varchar FROM series WHERE 'party-' || party_id::varchar NOT IN (SELECT id FROM left_) GROUP BY 2
    UNION ALL SELECT 'party_of_seats', holder, count(*)::varchar FROM seat_counts WHERE holder NOT IN ('others', 'total') AND holder NOT IN (SELECT id FROM left_) GROUP BY 2
    UNION ALL SELECT 'party_of_programme', party_id, count(*)::varchar FROM metrics WHERE party_id NOT IN (SELECT id FROM left_) GROUP BY 2
    UNION ALL SELECT 'precise_over_promises', party_id || '|' || document_id::varchar, (precise + 1)::varchar FROM metrics WHERE document_id % 10 = 4 AND precise + 1 > promises
    UNION ALL SELECT 'correction_without_reason', 'ballot:' || event_id::varchar, '' FROM events WHERE event_type = 'error'""")
def release_violations(d):
    """The same release with a party and a person taken out, a person twice, precise promises counted too high, and corrections
    without a reason."""
    given = sections(d)
    subjects = given["subjects"]
    given["subjects"] = subjects.filter(~F.col("id").isin("party-3", "person-11")).unionByName(subjects.filter("id = 'person-22'"))
    given["programmes"] = given["programmes"].withColumn("precise", F.col("precise") + F.when(F.col("document_id") % 10 == 4, 1).otherwise(0))
    given["corrections"] = given["corrections"].withColumn("reason", F.when(F.col("before") == "error", "").otherwise(F.col("reason")))
    # A section that several checks read is written, as `publish` does it; the corrections are read by one.
    given = {name: rows if name == "corrections" else written(rows, name) for name, rows in given.items()}
    return BU.violations(given, {"positions": True}, TX.PROGRAMME_THEMES)


def _fingerprint_sql(name: str, table: str, **columns: str) -> str:
    """The fingerprint of a table: each row as JSON, hashed, its hash read as three numbers, the numbers summed."""
    row = ", ".join(f"{c} := {e}" for c, e in sorted(columns.items()))
    sums = " || '|' || ".join(f"coalesce(sum(('0x' || substr(h, {1 + 10 * i}, 10))::bigint), 0)::varchar" for i in range(3))
    return f"SELECT '{name}' AS section, count(*) AS n_rows, sha256({sums}) AS fingerprint FROM (SELECT sha256(to_json(struct_pack({row}))::varchar) AS h FROM {table})"


_OWN = {c: c for c in ("n", "d", "metric", "party_id", "in_government")}
MANIFEST_SQL = f"""
    WITH {RE.TREND_SQL}, {RU.SEATS_SQL}, {TX.PROMISES_SQL},
    counts AS (SELECT document_id, count(*) AS promises, count(*) FILTER (precise) AS precise, {", ".join(f"count(*) FILTER (theme = '{t}') AS {t}" for t in TX.PROGRAMME_THEMES)}
      FROM precise GROUP BY 1),
    metrics AS (SELECT DISTINCT party_id, document_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("promises", "precise", *TX.PROGRAMME_THEMES))}
      FROM programmes LEFT JOIN counts USING (document_id) WHERE election = (SELECT max(election) FROM programmes))
    {_fingerprint_sql("series", "series", quarter="quarter::varchar", **_OWN)}
    UNION ALL {_fingerprint_sql("seats", "seat_counts", chamber="chamber", holder="holder", seats="seats")}
    UNION ALL {_fingerprint_sql("programmes", "metrics", **{c: c for c in ("party_id", "document_id", "promises", "precise", *TX.PROGRAMME_THEMES)})}"""


@query("manifest", MANIFEST_SQL)
def manifest(d):
    """Row counts and fingerprints of three sections, each over its whole rows."""
    return sinks.manifest({"series": RE.trend(d), "seats": RU.seats(d), "programmes": TX.programme_metrics(d)})
