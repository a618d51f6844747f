"""Adapter from the star-schema test tables to the domain tables.

`SHARED` is plain SQL that Spark and the oracle engine both run: it only reshapes columns (a ballot is a shipping week,
a person a customer, a group a nation, a party a region). Nothing that an operator computes is in it. `ORACLE` holds the
oracle's own SQL for the results other oracles build on.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyframe.operators import votes as V
from tallyframe.storage import written

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

_WEEK = "cast(date_trunc('week', l_shipdate) as date)"

SHARED = {
    # One row per appearance of a person on a ballot. Three weeks in four most people follow the party line.
    "vote_rows": f"""
        SELECT ballot_id, ballot_id AS on_date, person_id,
               CASE WHEN okey % 37 <> 0 THEN nationkey END AS group_id,
               CASE WHEN okey % 29 = 0 THEN CASE linenumber % 5 WHEN 0 THEN 'absent' WHEN 1 THEN 'on_mission'
                    WHEN 2 THEN 'not_voting' WHEN 3 THEN 'president' ELSE 'secret_voter' END
                    WHEN w % 4 < 3 AND okey % 16 <> 0 THEN
                    CASE (w + CASE WHEN regionkey < 2 THEN 0 WHEN regionkey < 4 THEN 1 ELSE w END) % 3
                    WHEN 0 THEN 'for' WHEN 1 THEN 'against' ELSE 'abstain' END
                    WHEN returnflag = 'R' THEN 'for' WHEN returnflag = 'A' THEN 'against' ELSE 'abstain'
               END AS expression
        FROM (SELECT {_WEEK} AS ballot_id, extract(week from {_WEEK}) AS w, o_custkey AS person_id,
                     l_orderkey AS okey, l_linenumber AS linenumber, l_returnflag AS returnflag,
                     c_nationkey AS nationkey, n_regionkey AS regionkey
              FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey
                   JOIN {{customer}} ON o_custkey = c_custkey
                   JOIN {{nation}} ON c_nationkey = n_nationkey) shipped""",
    "ballot_days": f"SELECT DISTINCT {_WEEK} AS ballot_id FROM {{lineitem}}",
    "ballot_facts": """
        SELECT ballot_id, ballot_date, seq, chamber, term,
               seq % 3 <> 0 AS is_final, seq % 11 = 0 AS is_confidence, seq % 7 = 0 AS is_secret,
               concat('v', cast(seq as string)) AS ext_id,
               CASE WHEN seq % 9 <> 0 THEN concat('C.', cast(1000 + seq as string)) END AS act_ref,
               CASE WHEN seq % 9 = 0 THEN NULL WHEN seq % 13 = 0 THEN
                    concat('Conversione in legge, con modificazioni, del decreto-legge ', cast(law % 28 + 1 as string),
                           ' marzo 1999, n. ', cast(law as string), ', recante &quot;misure urgenti&quot;')
                    ELSE concat('Misure n. ', cast(law as string), ' in materia di &quot;lavoro&quot;',
                    CASE WHEN chamber = 'upper' THEN concat(' (approvato dal Senato) (', cast(seq as string), ')')
                    ELSE '' END) END AS act_title,
               CASE WHEN seq % 5 = 0 THEN NULL ELSE seq % 2 = 0 END AS approved
        FROM (SELECT ballot_id, ballot_id AS ballot_date,
                     cast(extract(year from ballot_id) * 53 + floor((extract(doy from ballot_id) - 1) / 7) as int) AS seq,
                     cast(floor((extract(year from ballot_id) * 53 + floor((extract(doy from ballot_id) - 1) / 7)) / 2)
                       as int) % 97 AS law,
                     CASE WHEN extract(week from ballot_id) % 2 = 0 THEN 'lower' ELSE 'upper' END AS chamber,
                     CASE WHEN ballot_id < date '1998-01-01' THEN 18 ELSE 19 END AS term
              FROM ballot_days) days""",
    # Joint groups: nations with key mod 5 = 0 belong to a second party as well until the end of 1997.
    "group_party": """
        SELECT n_nationkey AS group_id, n_regionkey AS party_id, date '1995-01-01' AS valid_from,
               cast(NULL as date) AS valid_to
        FROM {nation} WHERE n_nationkey <> 24
        UNION ALL
        SELECT n_nationkey, (n_regionkey + 1) % 5, date '1995-01-01', date '1997-12-31'
        FROM {nation} WHERE n_nationkey % 5 = 0""",
    "party_roles": """
        SELECT r_regionkey AS party_id, CASE WHEN r_regionkey < 2 THEN 'government' ELSE 'opposition' END AS role,
               date '1995-01-01' AS valid_from, date '1998-06-30' AS valid_to FROM {region}
        UNION ALL
        SELECT r_regionkey, CASE WHEN r_regionkey < 2 THEN 'opposition' ELSE 'government' END, date '1998-07-01',
               cast(NULL as date) FROM {region}""",
    "persons": """
        SELECT c_custkey AS person_id, c_name AS name,
               CASE WHEN c_custkey % 11 = 0 THEN concat('person-', cast(c_custkey as string))
                    ELSE concat(CASE WHEN c_custkey % 2 = 0 THEN 'lower-' ELSE 'upper-' END,
                                cast(c_custkey as string)) END AS slug,
               CASE WHEN c_custkey % 3 = 0 THEN 'upper' ELSE 'lower' END AS chamber
        FROM {customer} WHERE c_custkey % 97 <> 5""",
    "memberships": """
        SELECT c_custkey AS person_id, 'group' AS kind, c_nationkey AS group_id, cast(NULL as int) AS party_id,
               date '1995-01-01' AS valid_from,
               CASE WHEN c_custkey % 13 = 0 THEN date '1998-03-31' END AS valid_to
        FROM {customer} WHERE c_custkey % 41 <> 7
        UNION ALL
        SELECT c_custkey, 'group', (c_nationkey + 1) % 25, cast(NULL as int), date '1998-04-01', cast(NULL as date)
        FROM {customer} WHERE c_custkey % 13 = 0
        UNION ALL
        SELECT c_custkey, 'party', cast(NULL as int), cast(c_custkey % 5 as int), date '1996-01-01', cast(NULL as date)
        FROM {customer} WHERE c_custkey % 11 = 0
        UNION ALL
        SELECT c_custkey, 'party', cast(NULL as int), cast((c_custkey + 1) % 5 as int), date '1997-01-01',
               date '1997-12-31'
        FROM {customer} WHERE c_custkey % 22 = 0
        UNION ALL
        SELECT c_custkey, 'party', cast(NULL as int), cast(c_custkey % 5 as int), date '1996-06-01', date '1999-12-31'
        FROM {customer} WHERE c_custkey % 33 = 0""",
    "act_corrections": """
        SELECT ballot_id, concat('C.', cast(2000 + seq as string)) AS act_ref,
               CASE WHEN seq % 4 = 0 THEN NULL ELSE concat('Riforma n. ', cast(seq as string)) END AS act_title,
               timestamp '2001-01-01 00:00:00' AS recorded_at
        FROM ballot_facts WHERE seq % 10 < 2
        UNION ALL
        SELECT ballot_id, cast(NULL as string), CASE WHEN seq % 8 = 0 THEN NULL ELSE concat('Testo unificato n. ',
               cast(seq as string)) END, timestamp '2001-02-01 00:00:00'
        FROM ballot_facts WHERE seq % 10 = 1""",
    # Every eligible ballot gives a statement, the latest first.
    "statements": """
        SELECT ballot_id, concat('s', cast(row_number() OVER (ORDER BY ballot_id DESC) - 1 as string)) AS statement_id,
               concat('t', cast(extract(doy from ballot_id) % 6 as string)) AS theme,
               CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END AS direction, chamber, term, ballot_date
        FROM (SELECT * FROM ballot_facts WHERE is_final AND NOT is_secret) eligible""",
    # Earlier ballots on the same matter anchor some statements too, so that means of several votes occur.
    "anchors": """
        SELECT statement_id, ballot_id, direction FROM statements
        UNION ALL
        SELECT s.statement_id, f.ballot_id, CASE WHEN f.seq % 3 = 0 THEN -s.direction ELSE s.direction END
        FROM statements s JOIN ballot_facts f
          ON extract(week from f.ballot_id) = extract(week from s.ballot_id) AND f.ballot_id < s.ballot_id""",
    "answer_rows": """
        SELECT event_id, ts, user_id AS respondent_id, concat('s', cast(event_id % 40 as string)) AS statement_id,
               CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 WHEN 'view' THEN 0 WHEN 'error' THEN -2 END
                 AS value,
               value > 10 AS important
        FROM {events}""",
}

ORACLE = {
    "votes": """
        SELECT ballot_id, on_date, person_id, max(group_id) FILTER (best) AS group_id, max(expression) FILTER (best) AS expression
        FROM (SELECT *, expression = first_value(expression) OVER (PARTITION BY ballot_id, person_id ORDER BY
                list_position(['absent', 'on_mission', 'not_voting', 'president', 'secret_voter', 'abstain', 'against', 'for'], expression) DESC) AS best
              FROM vote_rows)
        GROUP BY ballot_id, on_date, person_id""",
    "group_periods": "SELECT person_id, group_id, valid_from, valid_to FROM memberships WHERE kind = 'group'",
    "grouped_votes": """
        SELECT v.ballot_id, v.on_date, v.person_id, v.expression,
               coalesce(v.group_id, (SELECT p.group_id FROM group_periods p
                 WHERE p.person_id = v.person_id AND v.on_date >= p.valid_from
                   AND (p.valid_to IS NULL OR v.on_date <= p.valid_to)
                 ORDER BY p.valid_from DESC, p.group_id DESC LIMIT 1)) AS group_id
        FROM votes v""",
    "group_counts": """
        SELECT ballot_id, on_date, group_id, count(*) FILTER (expression = 'for') AS n_for,
               count(*) FILTER (expression = 'against') AS n_against,
               count(*) FILTER (expression = 'abstain') AS n_abstain,
               count(*) FILTER (expression NOT IN ('for', 'against', 'abstain')) AS n_other
        FROM grouped_votes GROUP BY ballot_id, on_date, group_id""",
    "ballot_sums": """
        SELECT ballot_id, cast(sum(n_for) as bigint) AS t_for, cast(sum(n_against) as bigint) AS t_against,
               cast(sum(n_abstain) as bigint) AS t_abstain FROM group_counts GROUP BY ballot_id""",
    "ballots": """
        SELECT f.*, t_for + CASE WHEN seq % 20 = 0 THEN 1 ELSE 0 END AS n_for, t_against AS n_against,
               t_abstain AS n_abstain, seq % 20 <> 0 AS coherent
        FROM ballot_facts f JOIN ballot_sums USING (ballot_id)""",
    "party_votes": """
        SELECT c.ballot_id, c.on_date, g.party_id, cast(sum(n_for) as bigint) AS n_for,
               cast(sum(n_against) as bigint) AS n_against, cast(sum(n_abstain) as bigint) AS n_abstain
        FROM group_counts c JOIN group_party g ON g.group_id = c.group_id AND c.on_date >= g.valid_from
             AND (g.valid_to IS NULL OR c.on_date <= g.valid_to)
        WHERE (SELECT count(*) FROM group_party h WHERE h.group_id = c.group_id AND c.on_date >= h.valid_from
               AND (h.valid_to IS NULL OR c.on_date <= h.valid_to)) = 1
        GROUP BY c.ballot_id, c.on_date, g.party_id""",
    "acts_now": """
        SELECT f.ballot_id, CASE WHEN a.ballot_id IS NULL THEN f.act_ref ELSE a.act_ref END AS act_ref,
               CASE WHEN a.ballot_id IS NULL THEN f.act_title ELSE a.act_title END AS act_title
        FROM ballot_facts f LEFT JOIN (SELECT * FROM act_corrections QUALIFY row_number() OVER
             (PARTITION BY ballot_id ORDER BY recorded_at DESC) = 1) a ON a.ballot_id = f.ballot_id""",
}


_SCHEMAS: dict[str, StructType] = {}


def plain(sql: str) -> str:
    return re.sub(r"\{(\w+)\}", r"\1", sql)


class Domain:
    """The domain tables of one data folder, built lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        """A base table. Its schema is read once per process and then given, so no query waits for inference. Files are read
        as they lie: how they split is a matter of spark.sql.files.maxPartitionBytes."""
        path = f"{self.folder}/{name}.parquet"
        if path not in _SCHEMAS:
            _SCHEMAS[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_SCHEMAS[path]).parquet(path)

    def shared(self, name: str) -> DataFrame:
        """A shared view, with the views it names inlined as a WITH list."""
        order: list[str] = []

        def visit(view: str) -> None:
            for other in SHARED:
                if other != view and other not in order and re.search(rf"\b{other}\b", SHARED[view]):
                    visit(other)
            if view not in order:
                order.append(view)

        visit(name)
        bodies = {v: SHARED[v] for v in order}
        held = {}
        if "ballot_days" in bodies:
            bodies["ballot_days"], held = "SELECT * FROM {ballot_days}", {"ballot_days": self.ballot_days}
        text = "WITH " + ", ".join(f"{v} AS ({body})" for v, body in bodies.items()) + f" SELECT * FROM {name}"
        used = {t: self.table(t) for t in TABLES if f"{{{t}}}" in text}
        return self.spark.sql(text, **used, **held)

    @cached_property
    def ballot_days(self) -> DataFrame:
        """Written once: a row a week, from all lines, and most views start from it."""
        return written(self.spark.sql(SHARED["ballot_days"], lineitem=self.table("lineitem")), "ballot-days")

    @cached_property
    def votes(self) -> DataFrame:
        rows = self.shared("vote_rows")
        return V.one_vote_per_person(rows).withColumn("on_date", F.col("ballot_id"))

    def votes_of(self, people: DataFrame) -> DataFrame:
        """The votes of the people named (person_id); the rows of all others are left out before one is picked."""
        rows = self.shared("vote_rows").join(people.select("person_id"), "person_id", "left_semi")
        return V.one_vote_per_person(rows).withColumn("on_date", F.col("ballot_id"))

    @cached_property
    def group_counts(self) -> DataFrame:
        """Written once: a few rows a ballot, from all votes, and most of what is built on them reads them several times."""
        return written(V.ballot_group_counts(self.votes, self.shared("memberships")), "group-counts")

    @cached_property
    def dated_counts(self) -> DataFrame:
        return self.group_counts.withColumn("on_date", F.col("ballot_id"))

    @cached_property
    def ballots(self) -> DataFrame:
        """Ballot facts with declared totals; every twentieth declaration is off by one."""
        totals = V.ballot_totals(self.group_counts)
        off = F.when(F.col("seq") % 20 == 0, 1).otherwise(0)
        return self.shared("ballot_facts").join(totals.drop("n_other"), "ballot_id").withColumn(
            "n_for", F.col("n_for") + off
        )
