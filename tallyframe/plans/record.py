"""Queries on votes, periods and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.functions import dates, rules
from tallyframe.operators import series as S
from tallyframe.operators import temporal as T
from tallyframe.operators import votes as V
from tallyframe.plans.registry import query


def trend(d):
    return S.trend_series(d.group_counts, d.shared("ballot_facts"), d.shared("group_party"), d.shared("party_roles"))


# The oracle's own SQL of the dense series, used by every query that starts from it.
TREND_SQL = """
bloc AS (
  SELECT v.ballot_id, sum(n_for) AS g_for, sum(n_against) AS g_against, sum(n_abstain) AS g_abstain
  FROM party_votes v JOIN party_roles r ON r.party_id = v.party_id AND r.role = 'government'
       AND v.on_date >= r.valid_from AND (r.valid_to IS NULL OR v.on_date <= r.valid_to)
  GROUP BY v.ballot_id),
scoped AS (
  SELECT v.*, date_trunc('quarter', v.on_date)::date AS quarter, n_for + n_against + n_abstain AS cast_votes,
         greatest(n_for, n_against, n_abstain) AS top,
         coalesce(g_for, 0) AS g_for, coalesce(g_against, 0) AS g_against, coalesce(g_abstain, 0) AS g_abstain
  FROM party_votes v JOIN ballot_facts f USING (ballot_id) LEFT JOIN bloc USING (ballot_id)
  WHERE f.is_final AND NOT f.is_secret AND f.term = 19),
chosen AS (
  SELECT *, CASE WHEN top > 0 AND (n_for = top)::int + (n_against = top)::int + (n_abstain = top)::int = 1
                 THEN CASE WHEN n_for = top THEN 1 WHEN n_against = top THEN 2 ELSE 3 END END AS choice,
         greatest(g_for, g_against, g_abstain) AS g_top FROM scoped),
flagged AS (
  SELECT *, CASE WHEN g_top > 0 AND (g_for = g_top)::int + (g_against = g_top)::int + (g_abstain = g_top)::int = 1
                 THEN CASE WHEN g_for = g_top THEN 1 WHEN g_against = g_top THEN 2 ELSE 3 END END AS g_choice
  FROM chosen),
sums AS (
  SELECT party_id, quarter, 'votes_with_government' AS metric,
         count(*) FILTER (cast_votes >= 3 AND choice = g_choice) AS n,
         count(*) FILTER (cast_votes >= 3 AND choice IS NOT NULL AND g_choice IS NOT NULL) AS d
  FROM flagged GROUP BY 1, 2
  UNION ALL
  SELECT party_id, quarter, 'votes_united', count(*) FILTER (cast_votes >= 3 AND 10 * top >= 9 * cast_votes),
         count(*) FILTER (cast_votes >= 3) FROM flagged GROUP BY 1, 2),
grid AS (
  SELECT p.party_id, m.metric, q.quarter
  FROM (SELECT DISTINCT party_id FROM scoped) p,
       (VALUES ('votes_with_government'), ('votes_united')) m(metric),
       (SELECT unnest(generate_series((SELECT min(quarter) FROM scoped)::timestamp,
                                      (SELECT max(quarter) FROM scoped)::timestamp, interval 3 month))::date AS quarter) q),
series AS (
  SELECT g.party_id, g.quarter, g.metric, coalesce(s.n, 0) AS n, coalesce(s.d, 0) AS d,
         EXISTS (SELECT 1 FROM party_roles r WHERE r.party_id = g.party_id AND r.role = 'government'
           AND (g.quarter + interval 1 month + interval 14 day)::date >= r.valid_from
           AND (r.valid_to IS NULL OR (g.quarter + interval 1 month + interval 14 day)::date <= r.valid_to))
           AS in_government
  FROM grid g LEFT JOIN sums s USING (party_id, quarter, metric))
"""


@query("trend_series", f"WITH {TREND_SQL} SELECT * FROM series")
def trend_series(d):
    return trend(d)


@query("ballot_group_counts", "SELECT ballot_id, group_id, n_for, n_against, n_abstain, n_other FROM group_counts")
def ballot_group_counts(d):
    return d.group_counts


@query("ballot_coherence", """
    SELECT ballot_id, b.n_for AS declared_for, t_for AS counted_for,
           (t_for, t_against, t_abstain) = (b.n_for, b.n_against, b.n_abstain) AS coherent
    FROM ballots b JOIN ballot_sums USING (ballot_id)""")
def ballot_coherence(d):
    totals = V.ballot_totals(d.group_counts)
    checked = V.coherence(d.ballots, totals).select("ballot_id", F.col("n_for").alias("declared_for"), "coherent")
    return checked.join(totals.select("ballot_id", F.col("n_for").alias("counted_for")), "ballot_id")


@query("vote_priority_pick", "SELECT ballot_id, person_id, group_id, expression FROM votes")
def vote_priority_pick(d):
    return d.votes.drop("on_date")


@query("vote_contradictions", """
    SELECT ballot_id, person_id, count(DISTINCT expression)::int AS expressions FROM vote_rows
    WHERE expression IN ('for', 'against', 'abstain') GROUP BY 1, 2 HAVING count(DISTINCT expression) > 1""")
def vote_contradictions(d):
    return V.contradictions(d.shared("vote_rows"))


@query("party_counts", "SELECT ballot_id, party_id, n_for, n_against, n_abstain FROM party_votes")
def party_counts(d):
    return V.party_counts(d.dated_counts, d.shared("group_party")).drop("on_date")


@query("gov_bloc", """
    SELECT v.ballot_id, v.party_id, r.party_id IS NOT NULL AS in_government,
           coalesce(sum(n_for) FILTER (r.party_id IS NOT NULL) OVER b, 0)::bigint AS gov_for,
           coalesce(sum(n_against) FILTER (r.party_id IS NOT NULL) OVER b, 0)::bigint AS gov_against,
           coalesce(sum(n_abstain) FILTER (r.party_id IS NOT NULL) OVER b, 0)::bigint AS gov_abstain
    FROM party_votes v LEFT JOIN party_roles r ON r.party_id = v.party_id AND r.role = 'government'
         AND v.on_date >= r.valid_from AND (r.valid_to IS NULL OR v.on_date <= r.valid_to)
    WINDOW b AS (PARTITION BY v.ballot_id)""")
def gov_bloc(d):
    by_party = V.party_counts(d.dated_counts, d.shared("group_party"))
    return V.with_government_bloc(by_party, d.shared("party_roles")).select(
        "ballot_id", "party_id", "in_government", "gov_for", "gov_against", "gov_abstain"
    )


@query("quarter_calendar", """
    SELECT ballot_id, date_trunc('quarter', ballot_id)::date AS quarter,
           year(ballot_id)::varchar || '-T' || quarter(ballot_id)::varchar AS label,
           (date_trunc('quarter', ballot_id) + interval 1 month + interval 14 day)::date AS middle
    FROM ballot_days""")
def quarter_calendar(d):
    quarter = dates.quarter_start(F.col("ballot_id"))
    return d.shared("ballot_days").select(
        "ballot_id", quarter.alias("quarter"), dates.quarter_label(F.col("ballot_id")).alias("label"),
        dates.mid_quarter(quarter).alias("middle"),
    )


@query("party_at_date", """
    SELECT v.ballot_id, v.person_id, v.group_id,
           CASE WHEN (SELECT count(DISTINCT party_id) FROM group_party g WHERE g.group_id = v.group_id
                      AND v.on_date >= g.valid_from AND (g.valid_to IS NULL OR v.on_date <= g.valid_to)) = 1
                THEN (SELECT min(party_id) FROM group_party g WHERE g.group_id = v.group_id
                      AND v.on_date >= g.valid_from AND (g.valid_to IS NULL OR v.on_date <= g.valid_to))
                WHEN (SELECT count(DISTINCT party_id) FROM memberships m WHERE m.person_id = v.person_id
                      AND m.kind = 'party' AND v.on_date >= m.valid_from
                      AND (m.valid_to IS NULL OR v.on_date <= m.valid_to)) = 1
                THEN (SELECT min(party_id) FROM memberships m WHERE m.person_id = v.person_id AND m.kind = 'party'
                      AND v.on_date >= m.valid_from AND (m.valid_to IS NULL OR v.on_date <= m.valid_to))
           END AS party_id
    FROM votes v""")
def party_at_date(d):
    votes = d.votes.select("ballot_id", "on_date", "person_id", "group_id")
    return T.party_at_date(votes, d.shared("group_party"), d.shared("memberships")).drop("on_date")


@query("group_at_date", """
    SELECT ballot_id, person_id, (SELECT p.group_id FROM group_periods p WHERE p.person_id = v.person_id
             AND v.on_date >= p.valid_from AND (p.valid_to IS NULL OR v.on_date <= p.valid_to)
             ORDER BY p.valid_from DESC, p.group_id DESC LIMIT 1) AS group_id
    FROM votes v""")
def group_at_date(d):
    votes = d.votes.select("ballot_id", "on_date", "person_id")
    return T.group_at_date(votes, d.shared("memberships")).drop("on_date")


@query("act_current", "SELECT * FROM acts_now")
def act_current(d):
    return T.current_act(d.shared("ballot_facts"), d.shared("act_corrections"))


INCOMING = """SELECT ballot_id, act_ref, CASE WHEN seq % 6 = 0 THEN NULL WHEN seq % 5 = 0 THEN upper(act_title)
              ELSE act_title END AS act_title FROM ballot_facts WHERE seq % 3 <> 1"""


@query("acts_to_correct", f"""
    SELECT i.* FROM ({INCOMING}) i JOIN acts_now a USING (ballot_id)
    WHERE i.act_ref IS DISTINCT FROM a.act_ref OR i.act_title IS DISTINCT FROM a.act_title""")
def acts_to_correct(d):
    facts = d.shared("ballot_facts")
    seq = F.col("seq")
    incoming = facts.filter(seq % 3 != 1).select(
        "ballot_id", "act_ref",
        F.when(seq % 6 != 0, F.when(seq % 5 == 0, F.upper("act_title")).otherwise(F.col("act_title"))).alias("act_title"),
    )
    return T.acts_to_correct(T.current_act(facts, d.shared("act_corrections")), incoming)


@query("valid_at_filter", """
    SELECT f.ballot_id, r.party_id, r.role FROM ballot_facts f JOIN party_roles r
      ON f.ballot_date >= r.valid_from AND (r.valid_to IS NULL OR f.ballot_date <= r.valid_to)
      AND r.party_id = f.seq % 5""")
def valid_at_filter(d):
    facts = d.shared("ballot_facts").select("ballot_id", "ballot_date", (F.col("seq") % 5).cast("int").alias("party_id"))
    day = F.col("ballot_date")
    return (
        facts.join(d.shared("party_roles"), "party_id")
        .filter(dates.valid_at(day, F.col("valid_from"), F.col("valid_to")))
        .select("ballot_id", "party_id", "role")
    )


@query("latest_member", """
    SELECT person_id, chamber, group_id FROM (
      SELECT m.person_id, p.chamber, m.group_id, row_number() OVER (PARTITION BY m.person_id, p.chamber
             ORDER BY m.valid_from DESC, m.group_id DESC) AS rn
      FROM memberships m JOIN persons p USING (person_id)
      WHERE kind = 'group' AND m.valid_from <= date '1998-02-01'
        AND (m.valid_to IS NULL OR m.valid_to >= date '1998-02-01')) WHERE rn = 1""")
def latest_member(d):
    day = F.lit("1998-02-01").cast("date")
    members = d.shared("memberships").filter(
        (F.col("kind") == "group") & dates.valid_at(day, F.col("valid_from"), F.col("valid_to"))
    ).join(d.shared("persons").select("person_id", "chamber"), "person_id")
    return T.newest(
        members, ["person_id", "chamber"], [F.col("valid_from").desc(), F.col("group_id").desc()]
    ).select("person_id", "chamber", "group_id")


@query("selective_votes", """
    SELECT v.ballot_id, v.person_id, v.group_id, v.expression FROM votes v
    WHERE EXISTS (SELECT 1 FROM persons p WHERE p.person_id = v.person_id AND p.slug LIKE 'person-%')
       OR (SELECT count(*) FROM group_party g WHERE g.group_id = v.group_id AND v.on_date >= g.valid_from
           AND (g.valid_to IS NULL OR v.on_date <= g.valid_to)) > 1""")
def selective_votes(d):
    return V.votes_to_keep(d.votes, d.shared("persons"), d.shared("group_party")).drop("on_date")


@query("source_counts", """
    SELECT ballot_id, group_id, expression, count(DISTINCT person_id) AS n FROM vote_rows GROUP BY 1, 2, 3""")
def source_counts(d):
    return V.source_counts(d.shared("vote_rows"))


@query("unattributed", """
    SELECT ballot_id, expression, count(*) AS n FROM votes v
    WHERE NOT EXISTS (SELECT 1 FROM persons p WHERE p.person_id = v.person_id) GROUP BY 1, 2""")
def unattributed(d):
    return V.unattributed(d.votes, d.shared("persons"))


@query("orientation_person", """
    SELECT ballot_id, p.slug AS subject_id, CASE expression WHEN 'for' THEN 1 WHEN 'against' THEN -1
           WHEN 'abstain' THEN 0 END::int AS orientation
    FROM votes JOIN persons p USING (person_id) WHERE p.slug LIKE 'person-%'""")
def orientation_person(d):
    mine = V.tracked_positions_votes(d.votes, d.shared("persons"), d.shared("ballot_days"))
    return mine.select(
        "ballot_id", "subject_id", rules.orientation_of_expression(F.col("expression")).alias("orientation")
    )


@query("orientation_party", """
    SELECT ballot_id, party_id, CASE WHEN n_for + n_against + n_abstain < 3 THEN NULL
             WHEN 2 * (n_for - n_against) >= n_for + n_against + n_abstain THEN 1
             WHEN 2 * (n_against - n_for) >= n_for + n_against + n_abstain THEN -1 ELSE 0 END::int AS orientation
    FROM party_votes""")
def orientation_party(d):
    by_party = V.party_counts(d.dated_counts, d.shared("group_party"))
    counts = [F.col(c) for c in ("n_for", "n_against", "n_abstain")]
    return by_party.select("ballot_id", "party_id", rules.orientation_of_counts(*counts).alias("orientation"))


@query("minority_share", """
    SELECT ballot_id, round(coalesce(least(t_for, t_against) / nullif(t_for + t_against, 0), 0), 6) AS minority,
           t_for + t_against > 0 AND 4 * least(t_for, t_against) >= t_for + t_against AS divisive
    FROM ballot_sums""")
def minority_share(d):
    fav, con = F.col("n_for"), F.col("n_against")
    return V.ballot_totals(d.group_counts).select(
        "ballot_id", F.round(rules.minority_share(fav, con), 6).alias("minority"),
        rules.is_divisive(fav, con).alias("divisive"),
    )


WILSON_SQL = """
bounds AS (SELECT *, n / d AS p FROM series WHERE d > 0)"""


@query("wilson", f"""
    WITH {TREND_SQL}
    SELECT party_id, quarter, metric, CASE WHEN d = 0 THEN 0.0 ELSE round((n / d + 1.9208 / d
             - 1.96 * sqrt(n / d * (1 - n / d) / d + 0.9604 / (d * d))) / (1 + 3.8416 / d), 6) END::double AS low,
           CASE WHEN d = 0 THEN 1.0 ELSE round((n / d + 1.9208 / d
             + 1.96 * sqrt(n / d * (1 - n / d) / d + 0.9604 / (d * d))) / (1 + 3.8416 / d), 6) END::double AS high
    FROM series""")
def wilson(d):
    low, high = rules.wilson(F.col("n"), F.col("d"))
    return trend(d).select("party_id", "quarter", "metric", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query("year_over_year", f"""
    WITH {TREND_SQL},
    placed AS (SELECT *, row_number() OVER (PARTITION BY party_id, metric ORDER BY quarter DESC) AS back FROM series),
    years AS (
      SELECT party_id, metric, count(*) AS quarters,
             sum(n) FILTER (back <= 4)::bigint AS n_now, sum(d) FILTER (back <= 4)::bigint AS d_now,
             coalesce(sum(n) FILTER (back BETWEEN 5 AND 8), 0)::bigint AS n_before,
             coalesce(sum(d) FILTER (back BETWEEN 5 AND 8), 0)::bigint AS d_before
      FROM placed GROUP BY 1, 2),
    halves AS (
      SELECT *, n_now / d_now AS p, n_before / d_before AS q,
             1.96 * sqrt(n_now / d_now * (1 - n_now / d_now) / d_now + 0.9604 / (d_now * d_now)) AS mp,
             1.96 * sqrt(n_before / d_before * (1 - n_before / d_before) / d_before
                         + 0.9604 / (d_before * d_before)) AS mq
      FROM years)
    SELECT party_id, metric, quarters, n_now, d_now, n_before, d_before,
           CASE WHEN quarters < 8 OR d_now < 30 OR d_before < 30 THEN 'too_few'
                WHEN (p + 1.9208 / d_now - mp) / (1 + 3.8416 / d_now)
                     > (q + 1.9208 / d_before + mq) / (1 + 3.8416 / d_before) THEN 'more'
                WHEN (p + 1.9208 / d_now + mp) / (1 + 3.8416 / d_now)
                     < (q + 1.9208 / d_before - mq) / (1 + 3.8416 / d_before) THEN 'less'
                ELSE 'same' END AS verdict
    FROM halves""")
def year_over_year(d):
    return S.year_over_year(trend(d))


@query("whole_series", f"""
    WITH {TREND_SQL} SELECT party_id, metric, sum(n)::bigint AS n, sum(d)::bigint AS d FROM series GROUP BY 1, 2""")
def whole_series(d):
    return S.whole_series(trend(d))


@query("visible_points", f"""
    WITH {TREND_SQL},
    shown AS (SELECT party_id, quarter, metric, d >= 8 AS visible FROM series),
    starts AS (SELECT *, visible AND NOT coalesce(lag(visible) OVER w, false) AS starts FROM shown
               WINDOW w AS (PARTITION BY party_id, metric ORDER BY quarter))
    SELECT party_id, quarter, metric, visible, CASE WHEN visible THEN sum(starts::int) OVER
           (PARTITION BY party_id, metric ORDER BY quarter)::bigint END AS segment FROM starts""")
def visible_points(d):
    from dataclasses import replace

    from tallyframe.params import DEFAULT

    shown = S.visible_points(trend(d), replace(DEFAULT, min_denominator=8))
    return shown.select("party_id", "quarter", "metric", "visible", "segment")


@query("percent_gate", f"""
    WITH {TREND_SQL}, whole AS (SELECT party_id, metric, sum(n)::bigint AS n, sum(d)::bigint AS d FROM series GROUP BY 1, 2
      UNION ALL SELECT party_id, metric || '@' || quarter::varchar, n, d FROM series)
    SELECT party_id, metric, CASE WHEN d < 30 THEN n::varchar ELSE (floor((200 * n + d) / (2 * d))::bigint)::varchar || '%' END
             AS figure,
           CASE WHEN d > 0 AND 100 * n > 95 * d THEN 'almost all' WHEN d > 0 AND 100 * n > 66 * d THEN 'more than two in three'
                WHEN d > 0 AND 100 * n > 50 * d THEN 'more than half' WHEN d > 0 AND 100 * n > 33 * d THEN 'more than a third'
                WHEN d > 0 AND 100 * n > 25 * d THEN 'more than a quarter' ELSE 'less than a quarter' END AS words
    FROM whole""")
def percent_gate(d):
    quarters = trend(d)
    labelled = quarters.withColumn("metric", F.concat_ws("@", "metric", F.col("quarter").cast("string")))
    n, den = F.col("n"), F.col("d")
    rows = S.whole_series(quarters).unionByName(labelled.select("party_id", "metric", "n", "d"))
    return rows.select(
        "party_id", "metric", rules.gated_percent(n, den).alias("figure"), rules.share_in_words(n, den).alias("words")
    )


@query("freshness", """
    SELECT chamber, max(ballot_date) AS last_ballot, min(max(ballot_date)) OVER () AS votes_until
    FROM ballot_facts GROUP BY chamber""")
def freshness(d):
    from tallyframe.operators.quality import freshness as newest_per_chamber

    return newest_per_chamber(d.shared("ballot_facts"))
