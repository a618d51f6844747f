"""Hand-kept registries (parties, groups, people, sources, programme lists) to dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTIES = "parties array<struct<slug: string, name: string, roles: array<struct<role: string, valid_from: date, valid_to: date>>>>"
GROUPS = (
    "groups array<struct<chamber: string, term: int, ext_id: string, name: string, status: string, valid_from: date, "
    "parties: array<string>>>"
)
PEOPLE = (
    "people array<struct<slug: string, first_name: string, last_name: string, party: string, forms: array<string>, "
    "excluded_forms: array<string>, offices: array<struct<office: string, party: string, valid_from: date, valid_to: date>>>>"
)


def dimensions(parties: DataFrame, groups: DataFrame, people: DataFrame, term_start: str) -> dict[str, DataFrame]:
    """Dimension tables by name. Roles without a start and groups that are not verified are left out.

    A person's party period starts at the first office with a known date, else at the term's start.
    """
    party = parties.select(F.explode("parties").alias("p")).select("p.*")
    group = groups.select(F.explode("groups").alias("g")).select("g.*").filter(F.col("status") == "verified")
    person = people.select(F.explode("people").alias("x")).select("x.*")
    start = F.lit(term_start).cast("date")
    roles = party.select(F.col("slug").alias("party_id"), F.explode("roles").alias("r")).select("party_id", "r.*")
    dated = F.filter("offices", lambda o: o["valid_from"].isNotNull())
    return {
        "party": party.select("slug", "name").distinct(),
        "party_roles": roles.filter(F.col("valid_from").isNotNull()).distinct(),
        "groups": group.select("chamber", "term", "ext_id", "name").distinct(),
        "group_party": group.select(
            F.col("ext_id").alias("group_id"), F.explode("parties").alias("party_id"),
            F.coalesce("valid_from", start).alias("valid_from"), F.lit(None).cast("date").alias("valid_to"),
        ).distinct(),
        "persons": person.select("slug", "first_name", "last_name").distinct(),
        "memberships": person.select(
            F.col("slug").alias("person_id"), F.lit("party").alias("kind"), F.col("party").alias("party_id"),
            F.coalesce(F.get(dated, F.lit(0))["valid_from"], start).alias("valid_from"),
            F.lit(None).cast("date").alias("valid_to"),
        ).distinct(),
        "aliases": aliases(person),
    }


def aliases(people: DataFrame) -> DataFrame:
    """(slug, form, strict): listed forms are strict; surnames and excluded forms only tell that somebody is named."""
    strict = people.select("slug", F.explode("forms").alias("form"), F.lit(True).alias("strict"))
    loose = people.select(
        "slug",
        F.explode(F.array_append(F.coalesce("excluded_forms", F.array().cast("array<string>")), F.col("last_name"))).alias("form"),
        F.lit(False).alias("strict"),
    )
    return strict.unionByName(loose).distinct()


def active_sources(sources: DataFrame, search: dict[str, str] | None = None) -> DataFrame:
    """Active sources with `filtered` for level C, plus one search source when it is switched on."""
    kept = sources.filter(F.coalesce("active", F.lit(True))).select(
        "source", "level", "channel", "url", "link_pattern", (F.col("level") == "C").alias("filtered")
    )
    if not search:
        return kept
    row = kept.sparkSession.createDataFrame(
        [(search["source"], search["level"], search["channel"], "", None, True)], kept.schema
    )
    return kept.unionByName(row)


def programme_files(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The single programme file of each list entry, and violations for entries without exactly one file name.

    entries: list_no, ord, folder, file_name, kind, base_url. The first row of an entry gives the address.
    """
    found = entries.filter(F.col("kind") == "programme").groupBy("list_no").agg(
        F.count_distinct("file_name").alias("_names"), F.min_by(F.struct("base_url", "folder", "file_name"), "ord").alias("_f")
    )
    every = entries.select("list_no").distinct().join(found, "list_no", "left")
    names = F.coalesce("_names", F.lit(0))
    number = F.col("list_no").cast("string")
    encoded = F.replace(F.url_encode("_f.file_name"), F.lit("+"), F.lit("%20"))
    address = F.concat(
        F.col("_f.base_url"), F.lit("Documenti/"), number, F.coalesce("_f.folder", F.lit("")), F.lit("/"), encoded
    )
    one = every.filter(names == 1).select("list_no", address.alias("url"))
    other = every.filter(names != 1).select(
        F.lit("programme_file").alias("check"), number.alias("key"), names.cast("string").alias("detail")
    )
    return one, other


def read_bundle(spark: SparkSession, folder: str, fallback: str, name: str, schema: str) -> DataFrame:
    """A published section: from the folder, else from the fallback, else empty with the same schema."""
    from pyspark.errors import AnalysisException

    for place in (folder, fallback):
        try:
            return spark.read.schema(schema).json(f"{place}/{name}", mode="FAILFAST")
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)
