"""Landed rows of the two chambers to typed records. A value that cannot be read becomes NULL and shows up in
`unreadable`; nothing is guessed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import text as X
from tallyframe.functions.dates import compact_date, iso_prefix_date
from tallyframe.operators.temporal import newest
from tallyframe.operators.votes import decode_expression

# Where identifiers sit in the sources' addresses.
LOWER_BALLOT = r"votazione\.rdf/(vs\d+_\w+)$"
LOWER_MEMBER = r"deputato\.rdf/d(\d+)_\d+$"
LOWER_GROUP = r"gruppoParlamentare\.rdf/(gr\d+)$"
LOWER_ACT = r"attocamera\.rdf/ac\d+_(\w+)$"
LOWER_ACT_TEXT = r"(?i)\b(?:DDL|PDL|PDLC|DOC)\s+(\d+)"
UPPER_BALLOT = r"/votazione/(\d+-\d+-\d+)$"
UPPER_MEMBER = r"/senatore/(\d+)$"
UPPER_GROUP = r"/gruppo/(\d+)$"
TRUE = ("1", "true", "True")
# Edge of an upper-house ballot to the expression it means.
EDGES = {
    "favorevole": "for", "contrario": "against", "astenuto": "abstain", "presidente": "president",
    "presenteNonVotante": "not_voting", "inCongedoMissione": "on_mission",
}


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _flag(text: Column) -> Column:
    return F.coalesce(text.isin(*TRUE), F.lit(False))


def act_ref(uri: Column, description: Column) -> Column:
    number = F.coalesce(_found(uri, LOWER_ACT), _found(description, LOWER_ACT_TEXT))
    return F.concat(F.lit("C."), number)


def lower_ballots(rows: DataFrame, term: int) -> DataFrame:
    """(row: map) to ballots of the lower chamber, one per address: sources double their rows, and a linked act multiplies
    them. Of several rows the one with an act, then the smallest, is taken."""
    r = F.col("row")
    title, description = _filled(r["titolo"]), _filled(r["descr"])
    made = rows.select(
        F.lit("lower").alias("chamber"), F.lit(term).alias("term"), _found(r["v"], LOWER_BALLOT).alias("ext_id"),
        compact_date(r["data"]).alias("ballot_date"), _filled(r["tipo"]).alias("kind"), title.alias("title"),
        description.alias("description"), act_ref(r["atto"], description).alias("act_ref"),
        X.clean_title(r["atto_titolo"]).alias("act_title"), _flag(r["finale"]).alias("is_final"),
        _flag(r["fiducia"]).alias("is_confidence"), _flag(r["segreta"]).alias("is_secret"),
        *[F.expr(f"try_cast(row['{k}'] AS int)").alias(c) for k, c in (("fav", "n_for"), ("con", "n_against"), ("ast", "n_abstain"))],
        F.when(r["approvato"].isNotNull(), _flag(r["approvato"])).alias("approved"),
        F.coalesce(F.nullif(r["url"], F.lit("")), r["v"]).alias("url"), r["v"].alias("_address"),
    )
    order = [F.col("act_ref").isNull(), F.to_json(F.struct([c for c in made.columns if c != "_address"]))]
    return newest(made, ["_address"], order).drop("_address")


def lower_votes(rows: DataFrame) -> DataFrame:
    r = F.col("row")
    return rows.select(
        _found(r["v"], LOWER_BALLOT).alias("ballot_ext_id"), _found(r["dep"], LOWER_MEMBER).alias("person_ext_id"),
        decode_expression(r["tipo"], r["descr"]).alias("expression"), _found(r["gruppo"], LOWER_GROUP).alias("group_ext_id"),
    )


def lower_counts(rows: DataFrame) -> DataFrame:
    r = F.col("row")
    return rows.select(
        _found(r["v"], LOWER_BALLOT).alias("ballot_ext_id"), _found(r["gruppo"], LOWER_GROUP).alias("group_ext_id"),
        decode_expression(r["tipo"], r["descr"]).alias("expression"), F.expr("try_cast(row['n'] AS bigint)").alias("n"),
    )


def selected_votes(votes: DataFrame, people: DataFrame, groups: DataFrame) -> DataFrame:
    """Votes (vote_uri, person_ext_id, group_ext_id, ...) without a group, of tracked people, or of the given groups.

    One scan with two flags instead of three queries and their union; a vote kept for two reasons appears once.
    """
    tracked = people.select("person_ext_id").distinct().withColumn("_p", F.lit(True))
    shared = groups.select("group_ext_id").distinct().withColumn("_g", F.lit(True))
    flagged = votes.join(tracked, "person_ext_id", "left").join(shared, "group_ext_id", "left")
    wanted = F.col("group_ext_id").isNull() | F.col("_p").isNotNull() | F.col("_g").isNotNull()
    return flagged.filter(wanted).dropDuplicates(["vote_uri"]).select(*votes.columns)


def votes_of_ballots(votes: DataFrame, ballots: DataFrame, first_day, last_day) -> DataFrame:
    """Votes of the given ballots. On a table laid out by day the two dates prune its folders before anything is read."""
    days = F.col("ballot_date").between(F.lit(first_day), F.lit(last_day))
    return votes.filter(days).join(ballots.select("ballot_ext_id").distinct(), "ballot_ext_id", "left_semi")


def approved(outcome: Column) -> Column:
    """TRUE / FALSE / NULL. The negative is read first, so that 'non approvato' is a rejection."""
    text = F.lower(F.coalesce(outcome, F.lit("")))
    return F.when(text.contains("respint") | text.contains("non approv"), False).when(text.contains("approv"), True)


def choose_act(acts: Column) -> tuple[Column, Column]:
    """(act_ref, act_title) from the documents linked to a ballot: array of (ddl, phase, state, title).

    Documents without a phase are ignored when some have one; absorbed ones unless all are. Several left: their phases
    in order and no title, because the title of the text voted on is not in the data.
    """

    def pick(entries: Column) -> Column:
        phased = F.filter(entries, lambda a: F.trim(F.coalesce(a["phase"], F.lit(""))) != "")
        voices = F.when(F.size(phased) > 0, phased).otherwise(entries)

        def survivors(v: Column) -> Column:
            alive = F.filter(v, lambda a: F.lower(F.trim(F.coalesce(a["state"], F.lit("")))) != "assorbito")
            return F.when((F.size(v) > 1) & (F.size(alive) > 0), alive).otherwise(v)

        return X.let(voices, survivors)

    def refs(v: Column) -> Column:
        def key(a: Column) -> Column:
            phase = F.trim(F.coalesce(a["phase"], F.lit("")))
            return F.struct(_number(phase).alias("number"), phase.alias("phase"))

        ordered = F.array_sort(F.array_distinct(F.transform(v, key)))
        return F.array_join(F.transform(ordered, lambda k: k["phase"]), ", ")

    left = pick(acts)
    one = F.size(left) == 1
    first = F.get(left, F.lit(0))
    ref = F.when(F.size(left) > 1, refs(left)).when(one, _filled(first["phase"]))
    return ref, F.when(one, _filled(first["title"]))


def _number(text: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).try_cast("int"), F.lit(0))


def linked_acts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, acts): the documents linked to each ballot, one per identifier (the first row wins).

    rows: keys, ord, ddl, phase, state, title. A ballot has a handful of documents.
    """
    from tallyframe.operators.temporal import newest

    blank = F.lit("")
    ident = F.coalesce(F.nullif("ddl", blank), F.nullif("phase", blank), F.nullif("title", blank))
    named = rows.withColumn("_id", ident).filter(F.col("_id").isNotNull())
    first = newest(named, [*keys, "_id"], [F.col("ord")])
    entry = F.struct("ord", "ddl", "phase", "state", "title")
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("acts"))


def chosen_acts(rows: DataFrame, keys: list[str]) -> DataFrame:
    ref, title = choose_act(F.col("acts"))
    return linked_acts(rows, keys).select(*keys, ref.alias("act_ref"), title.alias("act_title"))


def upper_ballots(rows: DataFrame, term: int) -> DataFrame:
    """(ord, row: map), several rows per ballot, to ballots of the upper chamber."""
    r = F.col("row")
    flat = rows.select("ord", r["v"].alias("v"), *[r[c].alias(c) for c in ("ddl", "fase", "stato", "titolo")], r.alias("row"))
    acts = chosen_acts(
        flat.select("v", "ord", "ddl", F.col("fase").alias("phase"), F.col("stato").alias("state"), F.col("titolo").alias("title")),
        ["v"],
    )
    first = flat.groupBy("v").agg(F.min_by("row", "ord").alias("row"))
    label = _filled(r["label"])
    said = F.lower(F.coalesce(label, F.lit("")))
    made = first.select(
        "v", F.lit("upper").alias("chamber"), F.lit(term).alias("term"), _found(F.col("v"), UPPER_BALLOT).alias("ext_id"),
        iso_prefix_date(r["data"]).alias("ballot_date"), label.alias("kind"), label.alias("title"),
        _filled(r["esito"]).alias("description"), said.startswith("votazione finale").alias("is_final"),
        said.contains("fiducia").alias("is_confidence"),
        F.lower(F.coalesce(r["tipoVot"], F.lit(""))).contains("segret").alias("is_secret"),
        F.expr("try_cast(row['fav'] AS int)").alias("n_for"), F.expr("try_cast(row['con'] AS int)").alias("n_against"),
        F.coalesce(F.expr("try_cast(row['ast'] AS int)"), F.lit(0)).alias("n_abstain"), approved(r["esito"]).alias("approved"),
        F.col("v").alias("url"),
    )
    return made.join(acts, "v", "left").drop("v")


def upper_votes(rows: DataFrame) -> DataFrame:
    """(row: map) with ballot, edge and member to vote rows; `one_vote_per_person` then picks by priority."""
    from tallyframe.operators.votes import _choose

    r = F.col("row")
    edge = F.regexp_replace(r["p"], "^.*/", "")
    return rows.select(
        _found(r["v"], UPPER_BALLOT).alias("ballot_id"), _found(r["sen"], UPPER_MEMBER).alias("person_id"),
        F.lit(None).cast("string").alias("group_id"), _choose(edge, EDGES).alias("expression"),
    )


def members(rows: DataFrame, chamber: str, uri: str, pattern: str) -> DataFrame:
    """(chamber, person_ext_id, first_name, last_name), one per person, names with capitals."""
    r = F.col("row")
    made = rows.select(
        F.lit(chamber).alias("chamber"), _found(r[uri], pattern).alias("person_ext_id"),
        F.initcap(r["nome"]).alias("first_name"), F.initcap(r["cognome"]).alias("last_name"),
    )
    first = made.groupBy("chamber", "person_ext_id").agg(F.min(F.struct("last_name", "first_name")).alias("_n"))
    return first.select("chamber", "person_ext_id", F.col("_n.first_name").alias("first_name"), F.col("_n.last_name").alias("last_name"))


def group_memberships(rows: DataFrame) -> DataFrame:
    """(person_ext_id, group_ext_id, valid_from, valid_to) of the lower chamber, repeated rows collapsed."""
    r = F.col("row")
    made = rows.select(
        _found(r["d"], LOWER_MEMBER).alias("person_ext_id"), _found(r["g"], LOWER_GROUP).alias("group_ext_id"),
        compact_date(r["inizio"]).alias("valid_from"), compact_date(r["fine"]).alias("valid_to"),
    )
    return made.groupBy("person_ext_id", "group_ext_id", "valid_from").agg(F.max("valid_to").alias("valid_to"))


def component_memberships(rows: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the mixed group to person-party periods, and the components the mapping does not know.

    rows: component, person_ext_id, valid_from, valid_to. mapping: component, party_id (NULL: no party, skipped).
    """
    known = rows.join(mapping, "component").filter(F.col("party_id").isNotNull())
    periods = known.groupBy("person_ext_id", "party_id", "valid_from").agg(F.max("valid_to").alias("valid_to"))
    unknown = rows.join(mapping, "component", "left_anti").select("component").distinct()
    return periods, unknown


def linked_components(periods: DataFrame, external_ids: DataFrame, parties: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Component periods tied to stored people: (rows to store, people missing, parties unknown).

    periods: chamber, person_ext_id, party_id, valid_from, valid_to. external_ids: chamber, person_ext_id, person_id. parties:
    party_id. stored: person_id, party_id, valid_from of the memberships there are. A period whose person, party and start are
    stored is not a new one; a person or party that is not known is named once.
    """
    found = periods.join(external_ids, ["chamber", "person_ext_id"], "left")
    missing = found.filter(F.col("person_id").isNull()).select("chamber", "person_ext_id").distinct()
    unknown = periods.join(parties.select("party_id"), "party_id", "left_anti").select("party_id").distinct()
    known = found.filter(F.col("person_id").isNotNull()).join(parties.select("party_id"), "party_id", "left_semi")
    new = known.groupBy("person_id", "party_id", "valid_from").agg(F.max("valid_to").alias("valid_to"))
    return new.join(stored.select("person_id", "party_id", "valid_from"), ["person_id", "party_id", "valid_from"], "left_anti"), missing, unknown


def of_both_chambers(lower: DataFrame, upper: DataFrame, keys: list[str]) -> DataFrame:
    """Memberships of two chambers as one table with the chamber they come from; a key repeated in a chamber is one row, that
    with the latest end (an open end is the latest)."""
    both = lower.withColumn("chamber", F.lit("lower")).unionByName(upper.withColumn("chamber", F.lit("upper")))
    last = F.max(F.struct(F.col("valid_to").isNull().alias("open"), F.col("valid_to").alias("valid_to"))).alias("_e")
    return both.groupBy("chamber", *keys).agg(last).select("chamber", *keys, F.col("_e.valid_to").alias("valid_to"))


GROUP_LABEL = r"^(.*?) \(([^()]*(?:\([^()]*\)[^()]*)*)\) \((\d{2}\.\d{2}\.\d{4})"


def group_labels(labels: DataFrame) -> DataFrame:
    """(label, name, acronym, valid_from) of 'NAME (ACRONYM) (dd.mm.yyyy...'; other labels are left out."""
    label = F.col("label")
    return labels.filter(label.rlike(GROUP_LABEL)).select(
        "label", F.trim(F.regexp_extract(label, GROUP_LABEL, 1)).alias("name"),
        F.regexp_extract(label, GROUP_LABEL, 2).alias("acronym"),
        F.to_date(F.try_to_timestamp(F.regexp_extract(label, GROUP_LABEL, 3), F.lit("dd.MM.yyyy"))).alias("valid_from"),
    )


def with_mandate(members_: DataFrame, mandates: DataFrame) -> DataFrame:
    """Adds `confirmed`: the person appears among those with a mandate in the term."""
    flag = mandates.select("person_ext_id").distinct().withColumn("_m", F.lit(True))
    return members_.join(flag, "person_ext_id", "left").withColumn("confirmed", F.col("_m").isNotNull()).drop("_m")


def unreadable(records: DataFrame, required: list[str]) -> DataFrame:
    """Violations of records in which a required value could not be read."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    return records.withColumn("_missing", missing).filter(F.size("_missing") > 0).select(
        F.lit("unreadable").alias("check"), F.to_json(F.struct(*[F.col(c) for c in records.columns])).alias("key"),
        F.array_join("_missing", ",").alias("detail"),
    )


def ballots_of_keys(ballots: DataFrame, keys: DataFrame) -> DataFrame:
    """The ballots whose (chamber, term, ext_id) is in the list; a key listed twice gives its ballot once."""
    return ballots.join(keys.select("chamber", "term", "ext_id").distinct(), ["chamber", "term", "ext_id"], "left_semi")
