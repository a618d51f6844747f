"""Queries on positions, seats, candidate ballots, readings and affinity."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tallyframe.functions import rules
from tallyframe.functions.text import clean_title, law_key
from tallyframe.operators import affinity as A
from tallyframe.operators import catalogue as C
from tallyframe.operators import positions as P
from tallyframe.operators import readings as R
from tallyframe.operators import seats as ST
from tallyframe.operators import temporal as T
from tallyframe.operators import votes as V
from tallyframe.params import DEFAULT
from tallyframe.plans.registry import query

# The registry of tracked parties and the list of themes.
TRACKED_PARTIES = [0, 1, 2, 3]
THEMES = ["t0", "t1", "t2", "t3", "t4", "t5"]
SEATS_DAY = date(1998, 2, 1)


def by_party(d):
    return V.party_counts(d.dated_counts, d.shared("group_party"))


def subjects(d):
    parties = d.table("region").select(
        F.concat(F.lit("party-"), F.col("r_regionkey").cast("string")).alias("subject_id")
    )
    return parties.unionByName(V.tracked_people(d.shared("persons")).select(F.col("slug").alias("subject_id")))


def evidence(d):
    facts = d.shared("ballot_facts").select("ballot_id", "ballot_date", "term")
    anchors = d.shared("anchors").join(facts, "ballot_id")
    persons = d.shared("persons")
    people = V.tracked_positions_votes(d.votes_of(V.tracked_people(persons)), persons, anchors)
    return P.party_evidence(anchors, by_party(d)).unionByName(P.person_evidence(anchors, people))


POSITIONS_SQL = """
oriented AS (
  SELECT 'party-' || party_id::varchar AS subject_id, ballot_id,
         CASE WHEN 2 * (n_for - n_against) >= n_for + n_against + n_abstain THEN 1
              WHEN 2 * (n_against - n_for) >= n_for + n_against + n_abstain THEN -1 ELSE 0 END AS o
  FROM party_votes WHERE n_for + n_against + n_abstain >= 3
  UNION ALL
  SELECT p.slug, v.ballot_id, CASE v.expression WHEN 'for' THEN 1 WHEN 'against' THEN -1 ELSE 0 END
  FROM votes v JOIN persons p USING (person_id)
  WHERE p.slug LIKE 'person-%' AND v.expression IN ('for', 'against', 'abstain')),
evidence AS (
  SELECT o.subject_id, a.statement_id, f.ballot_id, f.ballot_date, f.term, o.o AS vote, o.o * a.direction AS o
  FROM anchors a JOIN ballot_facts f USING (ballot_id) JOIN oriented o USING (ballot_id)),
current_term AS (
  SELECT subject_id, statement_id, count(*) AS votes, sum(o) AS s, bool_or(o = 1) AND bool_or(o = -1) AS split,
         max(ballot_date) AS since
  FROM evidence WHERE term = 19 GROUP BY 1, 2),
earlier_term AS (
  SELECT DISTINCT ON (subject_id, statement_id) subject_id, statement_id, o, ballot_date
  FROM evidence WHERE term < 19 ORDER BY subject_id, statement_id, ballot_date DESC, ballot_id DESC),
everyone AS (
  SELECT 'party-' || r_regionkey::varchar AS subject_id FROM region
  UNION ALL SELECT slug FROM persons WHERE slug LIKE 'person-%'),
positions AS (
  SELECT e.subject_id, s.statement_id,
         CASE WHEN c.votes IS NOT NULL THEN least(2, greatest(-2, round(2.0 * c.s / c.votes)::int))
              ELSE 2 * p.o END::int AS value,
         CASE WHEN c.split THEN 'divergent' WHEN c.votes IS NOT NULL OR p.o IS NOT NULL THEN 'documented'
              ELSE 'not_documented' END AS status,
         CASE WHEN c.votes IS NOT NULL THEN 'full' WHEN p.o IS NOT NULL THEN 'reduced' END AS confidence,
         coalesce(c.votes, CASE WHEN p.o IS NOT NULL THEN 1 ELSE 0 END)::bigint AS votes,
         coalesce(c.since, p.ballot_date) AS valid_from
  FROM everyone e CROSS JOIN statements s
  LEFT JOIN current_term c ON c.subject_id = e.subject_id AND c.statement_id = s.statement_id
  LEFT JOIN earlier_term p ON p.subject_id = e.subject_id AND p.statement_id = s.statement_id)
"""


def positions(d):
    return P.positions(subjects(d), d.shared("statements"), evidence(d))


@query("positions", f"WITH {POSITIONS_SQL} SELECT * FROM positions")
def positions_query(d):
    return positions(d)


@query("evidence_text", f"""
    WITH {POSITIONS_SQL},
    titled AS (
      SELECT e.subject_id, e.statement_id, e.ballot_id, f.chamber, e.ballot_date,
             CASE e.vote WHEN 1 THEN 'Ha votato a favore' WHEN -1 THEN 'Ha votato contro' ELSE
               CASE WHEN e.subject_id LIKE 'party-%' THEN 'Si è diviso' ELSE 'Si è astenuto' END END
             || CASE WHEN a.act_title IS NULL THEN '' ELSE ': ' || replace(a.act_title, '&quot;', '"') END AS full_text
      FROM evidence e JOIN ballot_facts f USING (ballot_id) JOIN acts_now a USING (ballot_id))
    SELECT subject_id, statement_id, ballot_id,
           CASE WHEN length(full_text) > 120 THEN rtrim(substr(full_text, 1, 119)) || '…' ELSE full_text END AS sentence,
           CASE chamber WHEN 'lower' THEN 'Camera' ELSE 'Senato' END || ', ' || day(ballot_date)::varchar || ' ' ||
           list_extract(['gennaio', 'febbraio', 'marzo', 'aprile', 'maggio', 'giugno', 'luglio', 'agosto', 'settembre',
                         'ottobre', 'novembre', 'dicembre'], month(ballot_date)::int) || ' ' || year(ballot_date)::varchar
             AS moment
    FROM titled""")
def evidence_text(d):
    facts = d.shared("ballot_facts")
    acts = T.current_act(facts, d.shared("act_corrections")).select(
        "ballot_id", clean_title(F.col("act_title")).alias("title")
    )
    rows = evidence(d).join(facts.select("ballot_id", "chamber"), "ballot_id").join(acts, "ballot_id")
    party = F.col("subject_id").startswith("party-")
    vote, title = F.col("vote"), F.col("title")
    sentence = F.when(party, P.evidence_text(vote, title, P.PARTY_SENTENCES)).otherwise(
        P.evidence_text(vote, title, P.PERSON_SENTENCES)
    )
    return rows.select(
        "subject_id", "statement_id", "ballot_id", sentence.alias("sentence"),
        P.when_text(F.col("chamber"), F.col("ballot_date")).alias("moment"),
    )


@query("latest_position", """
    WITH versions AS (
      SELECT user_id, event_id % 40 AS statement, 1 + event_id % 3 AS version, ts AS recorded_at, event_id, value
      FROM events)
    SELECT user_id, statement::bigint AS statement, version::bigint AS version, event_id, value FROM versions
    QUALIFY row_number() OVER (PARTITION BY user_id, statement ORDER BY version DESC, recorded_at DESC, event_id) = 1""")
def latest_position(d):
    versions = d.table("events").select(
        "user_id", (F.col("event_id") % 40).alias("statement"), (1 + F.col("event_id") % 3).alias("version"), "ts",
        "event_id", "value",
    )
    order = [F.col("version").desc(), F.col("ts").desc(), F.col("event_id")]
    return T.newest(versions, ["user_id", "statement"], order).drop("ts")


SEATS_SQL = """
members AS (
  SELECT m.person_id, p.chamber, m.group_id FROM memberships m JOIN persons p USING (person_id)
  WHERE kind = 'group' AND m.valid_from <= date '1998-02-01' AND (m.valid_to IS NULL OR m.valid_to >= date '1998-02-01')
  QUALIFY row_number() OVER (PARTITION BY m.person_id, p.chamber ORDER BY m.valid_from DESC, m.group_id DESC) = 1),
placed AS (
  SELECT m.*, CASE
      WHEN (SELECT count(DISTINCT party_id) FROM group_party g WHERE g.group_id = m.group_id
            AND date '1998-02-01' >= g.valid_from AND (g.valid_to IS NULL OR date '1998-02-01' <= g.valid_to)) = 1
      THEN (SELECT min(party_id) FROM group_party g WHERE g.group_id = m.group_id
            AND date '1998-02-01' >= g.valid_from AND (g.valid_to IS NULL OR date '1998-02-01' <= g.valid_to))
      WHEN (SELECT count(DISTINCT party_id) FROM memberships q WHERE q.person_id = m.person_id AND q.kind = 'party'
            AND date '1998-02-01' >= q.valid_from AND (q.valid_to IS NULL OR date '1998-02-01' <= q.valid_to)) = 1
      THEN (SELECT min(party_id) FROM memberships q WHERE q.person_id = m.person_id AND q.kind = 'party'
            AND date '1998-02-01' >= q.valid_from AND (q.valid_to IS NULL OR date '1998-02-01' <= q.valid_to))
    END AS party_id FROM members m),
held AS (SELECT chamber, CASE WHEN party_id IN (0, 1, 2, 3) THEN 'party-' || party_id::varchar ELSE 'others' END AS holder
         FROM placed),
seat_counts AS (
  SELECT c.chamber, h.holder, count(x.holder) AS seats
  FROM (SELECT DISTINCT chamber FROM held) c
  CROSS JOIN (VALUES ('party-0'), ('party-1'), ('party-2'), ('party-3'), ('others')) h(holder)
  LEFT JOIN held x ON x.chamber = c.chamber AND x.holder = h.holder GROUP BY 1, 2
  UNION ALL SELECT chamber, 'total', count(*) FROM held GROUP BY 1)
"""


def seats(d):
    return ST.seats(d.shared("memberships"), d.shared("persons"), d.shared("group_party"), TRACKED_PARTIES, SEATS_DAY)


@query("seats", f"WITH {SEATS_SQL} SELECT * FROM seat_counts")
def seats_query(d):
    return seats(d)


@query("seats_by_role", f"""
    WITH {SEATS_SQL}
    SELECT chamber, coalesce(role, 'none') AS role, sum(seats)::bigint AS seats
    FROM seat_counts LEFT JOIN party_roles r ON holder = 'party-' || r.party_id::varchar
         AND r.valid_from <= date '1998-02-01' AND (r.valid_to IS NULL OR r.valid_to >= date '1998-02-01')
    WHERE holder <> 'total' GROUP BY 1, 2""")
def seats_by_role(d):
    return ST.seats_by_role(seats(d), d.shared("party_roles"), SEATS_DAY)


@query("subject_roles", """
    SELECT r_regionkey AS party_id, CASE WHEN EXISTS (SELECT 1 FROM party_roles p WHERE p.party_id = r_regionkey
             AND p.role = 'government' AND date '1998-02-01' >= valid_from
             AND (valid_to IS NULL OR date '1998-02-01' <= valid_to)) THEN 'In government' ELSE 'In opposition' END AS role_text,
           (SELECT string_agg(name, ', ' ORDER BY person_id) FROM persons WHERE person_id % 5 = r_regionkey
            AND slug LIKE 'person-%') AS leaders
    FROM region""")
def subject_roles(d):
    leaders = V.tracked_people(d.shared("persons")).select(
        (F.col("person_id") % 5).cast("int").alias("party_id"), F.col("person_id").alias("ord"), "name"
    )
    parties = d.table("region").select(F.col("r_regionkey").alias("party_id"))
    return ST.subject_roles(parties, d.shared("party_roles"), leaders, SEATS_DAY)


CANDIDATES_SQL = """
eligible AS (
  SELECT b.ballot_id, b.ballot_date, b.ext_id, b.n_for, b.n_against,
         replace(replace(a.act_title, '&amp;', '&'), '&quot;', '"') AS title
  FROM ballots b JOIN acts_now a USING (ballot_id)
  WHERE b.term = 19 AND b.is_final AND b.coherent AND NOT b.is_confidence AND NOT b.is_secret AND a.act_title IS NOT NULL
    AND EXISTS (SELECT 1 FROM party_votes v WHERE v.ballot_id = b.ballot_id)),
sides AS (
  SELECT ballot_id, bool_or(2 * (n_for - n_against) >= n_for + n_against + n_abstain) AS pro,
         bool_or(2 * (n_against - n_for) >= n_for + n_against + n_abstain) AS con
  FROM party_votes WHERE party_id IN (0, 1, 2, 3) AND n_for + n_against + n_abstain >= 3 GROUP BY 1),
keyed AS (
  SELECT e.*, coalesce(s.pro AND s.con, false) AS both_sides,
         CASE WHEN regexp_matches(title, 'decreto-legge [0-9]{1,2}°? [\\p{L}\\p{N}_]+ [0-9]{4}, n\\. ?[0-9]+')
              THEN lower('decreto-legge ' || replace(regexp_extract(title,
                   'decreto-legge ([0-9]{1,2}°? [\\p{L}\\p{N}_]+ [0-9]{4}), n\\. ?([0-9]+)', 1), '°', '') || ' n ' ||
                   regexp_extract(title, 'decreto-legge ([0-9]{1,2}°? [\\p{L}\\p{N}_]+ [0-9]{4}), n\\. ?([0-9]+)', 2))
              ELSE substr(trim(regexp_replace(lower(regexp_replace(title, '(\\s*\\([^()]*\\))+\\s*$', '')),
                   '[^\\p{L}\\p{N}_]+', ' ', 'g')), 1, 160) END AS law
  FROM eligible e LEFT JOIN sides s USING (ballot_id)),
early AS (
  SELECT *, CASE WHEN n_for + n_against = 0 OR 4 * least(n_for, n_against) < n_for + n_against THEN 'not_divisive'
                 WHEN NOT both_sides THEN 'no_tracked_party_on_each_side' END AS first_reason FROM keyed),
judged AS (
  SELECT ballot_id, ballot_date, ext_id, law, least(n_for, n_against) AS minority_for, n_for + n_against AS minority_of,
         coalesce(first_reason, CASE WHEN EXISTS (SELECT 1 FROM early o WHERE o.first_reason IS NULL AND o.law = e.law
           AND (o.ballot_date > e.ballot_date OR (o.ballot_date = e.ballot_date AND o.ext_id < e.ext_id)))
           THEN 'same_law_voted_again' END) AS reason
  FROM early e)
"""


def judged(d):
    acts = T.current_act(d.shared("ballot_facts"), d.shared("act_corrections"))
    checked = V.coherence(d.ballots, V.ballot_totals(d.group_counts))
    return C.candidates(checked, acts, by_party(d), TRACKED_PARTIES)


@query("candidates", f"WITH {CANDIDATES_SQL} SELECT * FROM judged")
def candidates(d):
    return judged(d)


@query("discard_tally", f"WITH {CANDIDATES_SQL} SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1")
def discard_tally(d):
    return C.discard_tally(judged(d))


@query("law_key", """
    SELECT ballot_id, replace(act_title, '&quot;', '"') AS title,
           CASE WHEN act_title LIKE 'Conversione%' THEN lower('decreto-legge ' || regexp_extract(act_title,
                  'decreto-legge ([0-9]+ [a-z]+ [0-9]{4})', 1) || ' n ' || regexp_extract(act_title, ', n\\. ([0-9]+)', 1))
                ELSE trim(regexp_replace(lower(regexp_replace(replace(act_title, '&quot;', '"'),
                  '( \\([^()]*\\))+$', '')), '[^\\p{L}\\p{N}_]+', ' ', 'g')) END AS law
    FROM ballot_facts WHERE act_title IS NOT NULL""")
def law_key_query(d):
    title = clean_title(F.col("act_title"))
    return d.shared("ballot_facts").filter(F.col("act_title").isNotNull()).select(
        "ballot_id", title.alias("title"), law_key(title).alias("law")
    )


# Drafted statements: every eligible ballot of any term, with a text that recurs across themes and a minority share.
DRAFTS_SQL = """
drafts AS (
  SELECT f.ballot_id, 'd' || seq::varchar AS statement_id, f.ballot_date, 't' || (seq % 6)::varchar AS theme,
         CASE WHEN seq % 19 = 0 THEN '' ELSE 'Misura  N. ' || (law_no % 60)::varchar END AS text,
         round(least(t_for, t_against) / nullif(t_for + t_against, 0), 6) AS minority
  FROM (SELECT *, floor(seq / 2)::int AS law_no FROM ballot_facts) f JOIN ballot_sums USING (ballot_id))
"""


def drafts(d):
    totals = V.ballot_totals(d.group_counts)
    seq = F.col("seq")
    share = F.round(rules.minority_share(F.col("n_for"), F.col("n_against")), 6)
    return d.shared("ballot_facts").join(totals, "ballot_id").select(
        "ballot_id", F.concat(F.lit("d"), seq.cast("string")).alias("statement_id"), "ballot_date",
        F.concat(F.lit("t"), (seq % 6).cast("string")).alias("theme"),
        F.when(seq % 19 == 0, "").otherwise(
            F.concat(F.lit("Misura  N. "), (F.floor(seq / 2) % 60).cast("string"))
        ).alias("text"),
        share.alias("minority"),
    )


@query("balanced_selection", f"""
    WITH {DRAFTS_SQL},
    firsts AS (
      SELECT * FROM drafts QUALIFY text = '' OR row_number() OVER (PARTITION BY lower(text)
        ORDER BY theme, minority DESC, ballot_date DESC, statement_id) = 1),
    k AS (SELECT least(5, min(n)) AS k FROM (SELECT theme, count(*) AS n FROM firsts GROUP BY theme)),
    placed AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY minority DESC, ballot_date DESC, statement_id) AS rn
               FROM firsts)
    SELECT ballot_id, statement_id, ballot_date, theme, text, minority FROM placed, k WHERE rn <= k""")
def balanced_selection(d):
    return C.balanced_selection(drafts(d), THEMES)


@query("top_per_theme", f"""
    WITH {DRAFTS_SQL},
    best AS (SELECT * FROM drafts QUALIFY row_number() OVER (PARTITION BY theme ORDER BY ballot_date DESC, statement_id) = 1)
    SELECT statement_id, theme, ballot_date FROM best ORDER BY ballot_date DESC, statement_id LIMIT 3""")
def top_per_theme(d):
    return C.latest_on_distinct_themes(drafts(d)).select("statement_id", "theme", "ballot_date")


# Landed answers of a checker: several phrases per draft in different roles, one row per phrase.
TESTS_SQL = """
checks AS (
  SELECT d.statement_id, d.theme, CASE WHEN f.seq % 17 = 0 THEN 't9' ELSE d.theme END AS answer_theme, r.role,
         CASE WHEN r.role = 'opposite' THEN CASE WHEN f.seq % 7 = 0 THEN 'agree' ELSE 'against' END
              WHEN r.role = 'variant' AND f.seq % 5 = 0 THEN 'unsure' ELSE 'agree' END AS answer
  FROM drafts d JOIN ballot_facts f USING (ballot_id), (VALUES ('statement'), ('variant'), ('opposite')) r(role)),
tests AS (
  SELECT statement_id, theme, min(answer_theme) = theme AS theme_ok,
         bool_and(answer = 'agree') FILTER (role <> 'opposite') AS sensitivity_ok,
         bool_and(answer = 'against') FILTER (role = 'opposite') AS polarity_ok
  FROM checks GROUP BY 1, 2)
"""


def tests(d):
    facts = d.shared("ballot_facts").select("ballot_id", "seq")
    seq, role = F.col("seq"), F.col("role")
    base = drafts(d)
    answers = (
        base.join(facts, "ballot_id")
        .withColumn("role", F.explode(F.array(F.lit("statement"), F.lit("variant"), F.lit("opposite"))))
        .select(
            "statement_id", "role", F.when(seq % 17 == 0, "t9").otherwise(F.col("theme")).alias("answer_theme"),
            F.when(role == "opposite", F.when(seq % 7 == 0, "agree").otherwise("against"))
            .when((role == "variant") & (seq % 5 == 0), "unsure").otherwise("agree").alias("answer"),
        )
    )
    return C.statement_tests(base.select("statement_id", "theme"), answers)


@query("statement_tests", f"""
    WITH {DRAFTS_SQL}, {TESTS_SQL}
    SELECT *, theme_ok AND sensitivity_ok AND polarity_ok AS passed FROM tests""")
def statement_tests(d):
    return tests(d)


@query("catalogue_report", f"""
    WITH {DRAFTS_SQL}, {TESTS_SQL}
    SELECT count(*) AS verified, count(*) FILTER (theme_ok AND sensitivity_ok AND polarity_ok) AS passed,
           count(*) FILTER (NOT theme_ok) AS theme_failed, count(*) FILTER (NOT sensitivity_ok) AS sensitivity_failed,
           count(*) FILTER (NOT polarity_ok) AS polarity_failed FROM tests""")
def catalogue_report(d):
    return C.catalogue_report(tests(d))


@query("passed_per_theme", f"""
    WITH {DRAFTS_SQL}, {TESTS_SQL},
    counts AS (SELECT t.theme, count(x.theme) AS n FROM (VALUES ('t0'), ('t1'), ('t2'), ('t3'), ('t4'), ('t5')) t(theme)
      LEFT JOIN tests x ON x.theme = t.theme AND theme_ok AND sensitivity_ok AND polarity_ok GROUP BY 1)
    SELECT theme, n, (min(n) OVER ()) = (max(n) OVER ()) AS all_equal FROM counts""")
def passed_per_theme(d):
    return C.passed_per_theme(tests(d), THEMES)


@query("manual_exclusions", """
    SELECT statement_id, ballot_id FROM statements
    WHERE ballot_id NOT IN (SELECT ballot_id FROM ballot_facts WHERE seq % 4 = 0 AND seq % 8 <> 0)""")
def manual_exclusions(d):
    facts = d.shared("ballot_facts").filter("seq % 4 = 0")
    exclusions = facts.select("ballot_id", F.when(F.col("seq") % 8 == 0, " ").otherwise("withdrawn").alias("reason"))
    return C.without_excluded(d.shared("statements").select("statement_id", "ballot_id"), exclusions)


@query("usable_answers", """
    SELECT f.ballot_id, f.ext_id, 't' || (seq % 6)::varchar AS theme FROM ballot_facts f
    WHERE seq % 5 <> 0 AND seq % 7 <> 0""")
def usable_answers(d):
    facts = d.shared("ballot_facts")
    seq = F.col("seq")
    answers = facts.select(
        "ext_id", (seq % 5 == 0).alias("discard"), F.concat(F.lit("t"), (seq % 6).cast("string")).alias("theme"),
        F.lit("text").alias("statement"), F.when(seq % 7 != 0, "opposite text").alias("opposite"),
    )
    return C.usable_answers(facts, answers).select("ballot_id", "ext_id", "theme")


@query("import_readiness", """
    SELECT c.chamber, max(ballot_date) AS last_ballot,
           coalesce(date_diff('day', max(ballot_date), date '2001-11-30') <= 30, false) AS ready
    FROM (VALUES ('lower'), ('upper'), ('joint')) c(chamber) LEFT JOIN ballot_facts f ON f.chamber = c.chamber GROUP BY 1""")
def import_readiness(d):
    return C.import_readiness(d.shared("ballot_facts"), ["lower", "upper", "joint"], date(2001, 11, 30))


# ---- readings -------------------------------------------------------------------------------------------------------

# One wide row per customer segment x nation: numerators and denominators of the four published metrics.
METRICS_SQL = """
wide AS (
  SELECT c_mktsegment || '-' || c_nationkey::varchar AS subject_id,
         count(*) FILTER (o_orderstatus = 'F') AS wrong, count(*) AS checked,
         count(*) FILTER (o_orderpriority = '5-LOW') AS vague, count(*) AS claims,
         CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE count(*) FILTER (o_totalprice > 250000) END AS contrary,
         CASE WHEN c_nationkey % 6 = 0 THEN NULL ELSE count(*) END AS comparable,
         count(*) AS promises, count(*) FILTER (o_orderstatus = 'O') AS kept
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment, c_nationkey),
metrics AS (
  SELECT subject_id, 'wrong_numbers' AS metric, wrong AS n, checked AS d FROM wide
  UNION ALL SELECT subject_id, 'vague', vague, claims FROM wide
  UNION ALL SELECT subject_id, 'contrary_votes', contrary, comparable FROM wide WHERE comparable IS NOT NULL
  UNION ALL SELECT subject_id, 'promises_not_kept', promises - kept, promises FROM wide)
"""


def metrics(d):
    joined = d.table("orders").join(d.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    stated = F.col("c_nationkey") % 6 != 0
    wide = joined.groupBy("c_mktsegment", "c_nationkey").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("wrong"), F.count("*").alias("checked"),
        F.count_if(F.col("o_orderpriority") == "5-LOW").alias("vague"), F.count("*").alias("claims"),
        F.count_if(F.col("o_totalprice") > 250000).alias("_contrary"), F.count("*").alias("promises"),
        F.count_if(F.col("o_orderstatus") == "O").alias("kept"),
    )
    return R.metrics_of(wide.select(
        F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("subject_id"), "wrong", "checked",
        "vague", "claims", F.when(stated, F.col("_contrary")).alias("contrary"),
        F.when(stated, F.col("checked")).alias("comparable"), "promises", "kept",
    ))


@query("subject_metrics", f"WITH {METRICS_SQL} SELECT * FROM metrics")
def subject_metrics(d):
    return metrics(d)


@query("readings_pooled", f"""
    WITH {METRICS_SQL} SELECT metric, sum(n)::bigint AS n, sum(d)::bigint AS d FROM metrics GROUP BY 1 HAVING sum(d) > 0""")
def readings_pooled(d):
    return R.pooled(metrics(d))


@query("readings_ties", f"""
    WITH {METRICS_SQL},
    enough AS (SELECT *, count(*) OVER (PARTITION BY metric) AS rivals FROM metrics
               WHERE d >= 30 AND metric IN ('wrong_numbers', 'vague', 'promises_not_kept')),
    ranked AS (SELECT *, CASE WHEN metric = 'vague' THEN rank() OVER (PARTITION BY metric ORDER BY n / d)
                              ELSE rank() OVER (PARTITION BY metric ORDER BY n / d DESC) END AS place
               FROM enough WHERE rivals >= 2)
    SELECT metric, string_agg(subject_id, ' e ' ORDER BY subject_id) AS names, count(*) AS winners,
           arg_min(n, subject_id) AS n, arg_min(d, subject_id) AS d FROM ranked WHERE place = 1 GROUP BY metric""")
def readings_ties(d):
    return R.extremes(metrics(d), {"wrong_numbers": "max", "vague": "min", "promises_not_kept": "max"})


SENTENCES = [
    ("denominator < 30", "Only {d} cases"), ("share <= 0.2", "{n} of {d}: few"), ("share < 0.4", "{n} of {d}: some"),
    (None, "{n} of {d}: many"),
]


@query("first_rule_sentence", f"""
    WITH {METRICS_SQL}
    SELECT subject_id, metric, CASE WHEN d < 30 THEN 'Only ' || d::varchar || ' cases' ELSE n::varchar || ' of ' ||
           d::varchar || CASE WHEN d = 0 OR n / d <= 0.2 THEN ': few' WHEN n / d < 0.4 THEN ': some' ELSE ': many' END END
             AS sentence
    FROM metrics""")
def first_rule_sentence(d):
    return R.number_sentences(metrics(d), SENTENCES)


# ---- affinity -------------------------------------------------------------------------------------------------------

AFFINITY_SQL = f"""
{POSITIONS_SQL},
answers AS (
  SELECT * FROM answer_rows QUALIFY row_number() OVER (PARTITION BY respondent_id, statement_id
    ORDER BY ts DESC, event_id DESC) = 1),
scored AS (
  SELECT a.respondent_id, p.subject_id, p.statement_id, a.value AS u, p.value AS v, CASE WHEN a.important THEN 2 ELSE 1 END AS w
  FROM answers a JOIN positions p USING (statement_id)
  WHERE a.value IS NOT NULL AND a.value <> 0 AND p.subject_id LIKE 'party-%'),
affinity AS (
  SELECT respondent_id, subject_id,
         CASE WHEN count(v) > 0 THEN floor(100.0 * sum((4 - abs(u - v)) * w) / sum(4 * w) FILTER (v IS NOT NULL) + 0.5)::int
         END AS affinity, count(*) AS answered,
         coalesce(string_agg(statement_id, ',' ORDER BY statement_id) FILTER (v <> 0 AND sign(u) = sign(v)), '') AS agree,
         coalesce(string_agg(statement_id, ',' ORDER BY statement_id) FILTER (v <> 0 AND sign(u) <> sign(v)), '') AS disagree,
         coalesce(string_agg(statement_id, ',' ORDER BY statement_id) FILTER (v = 0), '') AS neutral,
         coalesce(string_agg(statement_id, ',' ORDER BY statement_id) FILTER (v IS NULL), '') AS missing
  FROM scored GROUP BY 1, 2),
placed AS (
  SELECT respondent_id, subject_id, affinity,
         row_number() OVER (PARTITION BY respondent_id ORDER BY coalesce(affinity, -1) DESC, subject_id)::int AS place,
         coalesce(affinity >= max(affinity) OVER (PARTITION BY respondent_id) - 3, false) AS leader,
         coalesce(max(affinity) OVER (PARTITION BY respondent_id) < 50, false) AS nobody
  FROM affinity)
"""


def party_positions(d):
    facts = d.shared("ballot_facts").select("ballot_id", "ballot_date", "term")
    found = P.party_evidence(d.shared("anchors").join(facts, "ballot_id"), by_party(d))
    parties = d.table("region").select(
        F.concat(F.lit("party-"), F.col("r_regionkey").cast("string")).alias("subject_id")
    )
    return P.positions(parties, d.shared("statements"), found)


def answers(d):
    return A.latest_answers(d.shared("answer_rows"))


@query("affinity", f"WITH {AFFINITY_SQL} SELECT * FROM affinity")
def affinity(d):
    return A.affinity(answers(d), party_positions(d))


@query("affinity_leaders", f"WITH {AFFINITY_SQL} SELECT * FROM placed")
def affinity_leaders(d):
    return A.ranked(A.affinity_scores(answers(d), party_positions(d)))


def areas(d):
    roles = ST.subject_roles(
        d.table("region").select(F.col("r_regionkey").alias("party_id")), d.shared("party_roles"),
        d.spark.createDataFrame([], "party_id int, ord int, name string"), date(2001, 1, 1),
    )
    return roles.select(
        F.concat(F.lit("party-"), F.col("party_id").cast("string")).alias("subject_id"),
        rules.area_of_role(F.col("role_text")).alias("area"),
    )


AREAS_SQL = """
areas AS (SELECT 'party-' || party_id::varchar AS subject_id, role AS area FROM party_roles WHERE valid_to IS NULL)
"""


@query("area_means", f"""
    WITH {POSITIONS_SQL}, {AREAS_SQL}
    SELECT area, statement_id, coalesce(sum(value), 0)::bigint AS total, count(value) AS known,
           coalesce(round(avg(value), 6), 0) AS mean
    FROM positions JOIN areas USING (subject_id) GROUP BY 1, 2""")
def area_means(d):
    return A.area_means(party_positions(d), areas(d))


@query("balance_audit", f"""
    WITH {AFFINITY_SQL}, {AREAS_SQL},
    means AS (SELECT subject_id, floor((20 * sum(affinity) + count(*)) / (2 * count(*))) / 10 AS m
              FROM affinity WHERE affinity IS NOT NULL GROUP BY 1),
    firsts AS (SELECT respondent_id, area, 1.0 / count(*) OVER (PARTITION BY respondent_id) AS part
               FROM placed JOIN areas USING (subject_id) WHERE leader),
    shares AS (SELECT a.area, coalesce(round((SELECT sum(part) FROM firsts f WHERE f.area = a.area)
                 / (SELECT count(DISTINCT respondent_id) FROM answers), 3), 0) AS share,
               count(*) / (SELECT count(*) FROM areas) AS expected FROM areas a GROUP BY a.area)
    SELECT 'mean_affinity' AS "check", subject_id AS key, printf('%.1f', m) AS detail FROM means WHERE abs(m - 50) > 5
    UNION ALL SELECT 'first_share', area, printf('%.3f', share) FROM shares WHERE abs(share - expected) * 100 > 10""")
def balance_audit(d):
    given = answers(d)
    scores = A.affinity_scores(given, party_positions(d))
    return A.balance_audit(scores, areas(d), given.select("respondent_id").distinct())


@query("area_recognition", f"""
    WITH {AFFINITY_SQL}, {AREAS_SQL},
    kinds AS (SELECT DISTINCT respondent_id, CASE WHEN respondent_id % 2 = 0 THEN 'government' ELSE 'opposition' END AS kind
              FROM answers),
    parts AS (SELECT respondent_id, kind, count(*) FILTER (area = kind) / count(*) AS part
              FROM placed JOIN areas USING (subject_id) JOIN kinds USING (respondent_id) WHERE leader GROUP BY 1, 2)
    SELECT kind AS area, round(sum(part) / count(*), 3) AS recognised FROM parts GROUP BY 1""")
def area_recognition(d):
    given = answers(d)
    kind = F.when(F.col("respondent_id") % 2 == 0, "government").otherwise("opposition")
    profiles = given.select("respondent_id").distinct().withColumn("profile_area", kind)
    return A.area_recognition(A.ranked(A.affinity_scores(given, party_positions(d))), areas(d), profiles)
