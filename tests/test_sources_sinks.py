from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyframe import sinks
from tallyframe.operators import quality as Q
from tallyframe.operators import release as R
from tallyframe.operators import temporal as T
from tallyframe.operators import votes as V
from tallyframe.sources import bindings as B
from tallyframe.sources import chambers as CH
from tallyframe.sources import feeds as FE
from tallyframe.sources import registry as RG
from tallyframe.storage import fresh_folder
from tallyframe.streaming import ingest as I
from tallyframe.streaming import reports as RP
from tallyframe.tables import KeyedTable, Ledger


def d(text):
    return date.fromisoformat(text)


def maps(spark, *rows_):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows_)], "ord int, row map<string,string>")


# ---- periods --------------------------------------------------------------------------------------------------------

LINKS = "group_id string, party_id string, valid_from date, valid_to date"
MEMBERS = "person_id string, kind string, group_id string, party_id string, valid_from date, valid_to date"


@pytest.mark.parametrize("group, person, expected", [
    ("one", "none", "a"), ("two", "single", "b"), ("two", "double", None), ("two", "repeat", "c"), (None, "single", "b"), ("same", "none", "a"), ("old", "none", None),
])
def test_party_at_date(spark, group, person, expected):
    links = spark.createDataFrame([
        ("one", "a", d("2020-01-01"), None), ("two", "a", d("2020-01-01"), None), ("two", "b", d("2020-01-01"), None), ("same", "a", d("2020-01-01"), None),
        ("same", "a", d("2021-01-01"), None), ("old", "a", d("2020-01-01"), d("2024-04-30")),
    ], LINKS)
    members = spark.createDataFrame([
        ("single", "party", None, "b", d("2020-01-01"), None), ("double", "party", None, "b", d("2020-01-01"), None), ("double", "party", None, "c", d("2020-01-01"), None),
        ("repeat", "party", None, "c", d("2020-01-01"), None), ("repeat", "party", None, "c", d("2022-01-01"), None),
    ], MEMBERS)
    facts = spark.createDataFrame([(person, group, d("2024-05-01"))], "person_id string, group_id string, on_date date")
    assert T.party_at_date(facts, links, members).first().party_id == expected


def test_joint_groups_are_left_out(spark):
    links = spark.createDataFrame([("g", "a", d("2020-01-01"), None), ("j", "a", d("2020-01-01"), None), ("j", "b", d("2020-01-01"), None)], LINKS)
    counts = spark.createDataFrame([("b", d("2024-01-01"), g, 3, 0, 0) for g in ("g", "j", "x", None)], "ballot_id string, on_date date, group_id string, n_for int, n_against int, n_abstain int")
    assert [tuple(r) for r in V.party_counts(counts, links).collect()] == [("b", d("2024-01-01"), "a", 3, 0, 0)]


def test_votes_without_group_take_the_latest_membership(spark, rows):
    members = spark.createDataFrame([("p", "group", "g1", None, d("2020-01-01"), None), ("p", "group", "g2", None, d("2021-01-01"), None)], MEMBERS)
    votes = spark.createDataFrame([("b", d("2024-01-01"), "p", None, "for"), ("b", d("2024-01-01"), "q", None, "absent"), ("b", d("2024-01-01"), "r", "g2", "abstain")],
                                  "ballot_id string, on_date date, person_id string, group_id string, expression string")
    assert rows(V.ballot_group_counts(votes, members)) == [("b", "g2", 1, 0, 1, 0), ("b", None, 0, 0, 0, 1)]


def test_counts_of_the_two_kinds_of_source_agree(spark, rows):
    members = spark.createDataFrame([], MEMBERS)
    votes = spark.createDataFrame([("b", d("2024-01-01"), str(i), "g", e) for i, e in enumerate(["for", "for", "against", "absent"])],
                                  "ballot_id string, on_date date, person_id string, group_id string, expression string")
    counted = V.source_counts(votes)
    assert rows(V.counts_from_source(lambda: {"source_counts": counted})) == rows(V.counts_from_source(lambda: {"votes": votes, "memberships": members}))


# ---- sources --------------------------------------------------------------------------------------------------------


def test_bindings(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"results": {"bindings": [{"v": {"type": "uri", "value": "x"}}, {"v": {"type": "uri", "value": "y"}, "n": {"type": "literal", "value": "2"}}]}}')
    assert [r.row for r in B.read_bindings(spark, str(tmp_path)).collect()] == [{"v": "x"}, {"v": "y", "n": "2"}]


def test_upper_ballots_and_act_choice(spark):
    base = {"v": "http://dati/votazione/19-12-3", "data": "2024-05-06T00:00:00", "label": "Votazione finale", "fav": "5", "con": "3", "esito": "non approvato"}
    rows_ = maps(spark, {**base, "ddl": "1", "fase": "S.10", "stato": "assorbito", "titolo": "A"}, {**base, "ddl": "2", "fase": "S.9", "stato": "approvato", "titolo": "B"},
                 {**base, "ddl": "3", "titolo": "petizione"})
    row = CH.upper_ballots(rows_, 19).first()
    assert (row.ext_id, row.ballot_date, row.is_final, row.approved, row.act_ref, row.act_title, row.n_abstain) == ("19-12-3", d("2024-05-06"), True, False, "S.9", "B", 0)
    several = maps(spark, {**base, "ddl": "1", "fase": "S.10", "titolo": "A"}, {**base, "ddl": "2", "fase": "S.9", "titolo": "B"})
    row = CH.upper_ballots(several, 19).first()
    assert (row.act_ref, row.act_title) == ("S.9, S.10", None)


def test_upper_edges_give_one_vote(spark, rows):
    def edge(p, s):
        return {"v": "http://dati/votazione/19-1-1", "p": f"http://dati/osr/{p}", "sen": f"http://dati/senatore/{s}"}
    votes = CH.upper_votes(maps(spark, edge("presenteNonVotante", 1), edge("favorevole", 1), edge("inCongedoMissione", 2), edge("strano", 3)))
    assert rows(V.one_vote_per_person(votes.filter("expression IS NOT NULL"))) == [("19-1-1", "1", None, "for"), ("19-1-1", "2", None, "on_mission")]
    assert CH.unreadable(votes, ["expression"]).count() == 1


def test_lower_ballot_dates_are_checked(spark):
    rows_ = maps(spark, {"v": "http://x/votazione.rdf/vs19_1_2", "data": "20240230", "fav": "1", "con": "x", "ast": "0"})
    bad = CH.unreadable(CH.lower_ballots(rows_, 19), ["ext_id", "ballot_date", "n_against"]).first()
    assert bad.detail == "ballot_date,n_against"


def test_selected_votes_once(spark, rows):
    votes = spark.createDataFrame([("u1", "p1", None), ("u1", "p1", None), ("u2", "p2", "g1"), ("u3", "p3", "g2"), ("u4", "p2", "g2")], "vote_uri string, person_ext_id string, group_ext_id string")
    people, groups = spark.createDataFrame([("p2",)], "person_ext_id string"), spark.createDataFrame([("g1",)], "group_ext_id string")
    assert [r[0] for r in rows(CH.selected_votes(votes, people, groups))] == ["u1", "u2", "u4"]


def test_votes_of_ballots(spark, rows):
    votes = spark.createDataFrame([("a", "p", d("2024-01-01")), ("a", "p", d("2024-02-01")), ("b", "p", d("2024-01-01"))], "ballot_ext_id string, person_ext_id string, ballot_date date")
    wanted = spark.createDataFrame([("a",), ("a",)], "ballot_ext_id string")
    assert rows(CH.votes_of_ballots(votes, wanted, d("2024-01-01"), d("2024-01-31"))) == [("a", "p", d("2024-01-01"))]


def test_rotation_depends_on_the_seed_only(spark, rows):
    items = spark.createDataFrame([(b, f"i{k}") for b in ("x", "y") for k in range(8)], "batch string, item string")
    one = rows(R.rotated(items, ["batch"], "item", "v1"))
    assert one == rows(R.rotated(items.orderBy(F.col("item").desc()), ["batch"], "item", "v1"))
    assert one != rows(R.rotated(items, ["batch"], "item", "v2"))


def test_names_sort_as_readers_expect(spark):
    df = spark.createDataFrame([("Zeta",), ("èlite",), ("Dado",), ("Fico",)], "name string")
    assert [r.name for r in R.alphabetical(df, "name").collect()] == ["Dado", "èlite", "Fico", "Zeta"]


def test_components_report_the_unknown(spark, rows):
    got = spark.createDataFrame([("c1", "p", d("2024-01-01"), None), ("c1", "p", d("2024-01-01"), d("2024-02-01")), ("c2", "q", d("2024-01-01"), None), ("c9", "r", d("2024-01-01"), None)],
                                "component string, person_ext_id string, valid_from date, valid_to date")
    mapping = spark.createDataFrame([("c1", "a"), ("c2", None)], "component string, party_id string")
    periods, unknown = CH.component_memberships(got, mapping)
    assert rows(periods) == [("p", "a", d("2024-01-01"), d("2024-02-01"))]
    assert rows(unknown) == [("c9",)]


def test_feed(spark):
    xml = ('<rss xmlns:content="c"><channel><item><title>Ciao  mondo</title><link>https://S.it/1?utm_a=1</link><pubDate>Tue, 06 Oct 2026 10:00:00 GMT</pubDate>'
           "<description>breve</description><content:encoded>&lt;p&gt;molto pi&amp;ugrave; lungo&lt;/p&gt;</content:encoded></item><item><title>senza</title></item></channel></rss>")
    got = FE.feed_elements(spark.createDataFrame([("s", xml)], "source string, xml string")).collect()
    assert [(e.url, e.title, e.summary, e.published_at) for e in got] == [("https://s.it/1", "Ciao mondo", "molto più lungo", datetime(2026, 10, 6, 10))]


def test_channel_preview(spark):
    def message(post, body, when):
        return f'<div class="msg js" data-post="{post}"><div class="msg_text">{body}</div><time datetime="{when}"></time></div>'
    html = message("c/1", "Prima<br/>seconda &amp; terza", "2026-10-06T10:00:00+00:00") + message("c/2", "", "2026-10-07") + message("c/3", "Ultima", "2026-10-07T10:00:00+00:00")
    df = spark.createDataFrame([("s", html)], "source string, html string")
    got = FE.channel_elements(df, "msg", "msg_text", "https://t.me/").orderBy("ord").collect()
    assert [(e.url, e.title, e.text) for e in got] == [("https://t.me/c/3", "Ultima", "Ultima"), ("https://t.me/c/1", "Prima", "Prima\nseconda & terza")]


def test_article_search(spark, rows):
    body = '{"articles": [{"url": "https://A.it/x#y", "title": " t ", "seendate": "20261006T100000Z", "domain": "a.it"}, {"title": "no"}]}'
    answers = spark.createDataFrame([("s", body), ("e", "Please limit requests"), ("z", "{}")], "source string, body string")
    elements, errors = FE.article_elements(answers)
    assert [(e.url, e.title, e.published_at) for e in elements.collect()] == [("https://a.it/x", "t", datetime(2026, 10, 6, 10))]
    assert rows(errors) == [("e", "Please limit requests")]


def test_registry(spark, rows):
    parties = spark.read.schema(RG.PARTIES).json(spark.sparkContext.parallelize(
        ['{"parties": [{"slug": "a", "name": "A", "roles": [{"role": "government", "valid_from": "2022-10-22"}, {"role": "opposition"}]}]}']))
    groups = spark.read.schema(RG.GROUPS).json(spark.sparkContext.parallelize(
        ['{"groups": [{"chamber": "lower", "term": 19, "ext_id": "g1", "name": "G", "status": "verified", "parties": ["a"]}, {"ext_id": "g2", "status": "unsure", "parties": ["a"]}]}']))
    people = spark.read.schema(RG.PEOPLE).json(spark.sparkContext.parallelize(
        ['{"people": [{"slug": "r", "first_name": "M", "last_name": "R", "party": "a", "forms": ["M R"], "excluded_forms": ["RR"], "offices": [{"office": "x"}, {"office": "y", "valid_from": "2023-01-01"}]}]}']))
    dims = RG.dimensions(parties, groups, people, "2022-10-13")
    assert rows(dims["party_roles"]) == [("a", "government", d("2022-10-22"), None)]
    assert rows(dims["group_party"]) == [("g1", "a", d("2022-10-13"), None)]
    assert rows(dims["memberships"]) == [("r", "party", "a", d("2023-01-01"), None)]
    assert rows(dims["aliases"]) == [("r", "M R", True), ("r", "R", False), ("r", "RR", False)]


def test_programme_file_must_be_one(spark, rows):
    df = spark.createDataFrame([(1, 0, "f", "a b.pdf", "programme", "https://x/"), (1, 1, "g", "a b.pdf", "programme", "https://x/"), (2, 0, "", "a.pdf", "programme", "https://x/"),
                                (2, 1, "", "b.pdf", "programme", "https://x/"), (3, 0, "", "c.pdf", "statute", "https://x/")],
                               "list_no int, ord int, folder string, file_name string, kind string, base_url string")
    one, bad = RG.programme_files(df)
    assert rows(one) == [(1, "https://x/Documenti/1f/a%20b.pdf")]
    assert rows(bad) == [("programme_file", "2", "2"), ("programme_file", "3", "0")]


def test_active_sources_and_bundle(spark, tmp_path):
    df = spark.createDataFrame([("a", "C", "rss", "u", None, None), ("b", "A", "rss", "u", None, False)], "source string, level string, channel string, url string, link_pattern string, active boolean")
    got = RG.active_sources(df, {"source": "search", "level": "C", "channel": "search"}).orderBy("source").collect()
    assert [(r.source, r.filtered) for r in got] == [("a", True), ("search", True)]
    (tmp_path / "sections").mkdir()
    (tmp_path / "sections" / "s.json").write_text('{"x": 1}\n')
    assert RG.read_bundle(spark, "/nonexistent", str(tmp_path / "sections"), "s.json", "x int").count() == 1
    assert RG.read_bundle(spark, "/nonexistent", "/none", "s.json", "x int").count() == 0


# ---- sinks ----------------------------------------------------------------------------------------------------------


def test_insert_is_idempotent(spark):
    path = fresh_folder(spark, "t")
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    assert sinks.insert_if_absent(df, path, ["k"], [F.col("v")]) == 2
    assert sinks.insert_if_absent(df, path, ["k"], [F.col("v")]) == 0
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {("a", 1), (None, 3)}


def test_appends_open_only_the_folders_of_their_keys(spark):
    schema = "k long, day date, v int"
    table = KeyedTable(spark, fresh_folder(spark, "keyed"), schema, ["k", "day"])
    many = spark.range(3000).selectExpr("id AS k", "IF(id % 7 = 0, NULL, date '2024-01-01') AS day", "cast(id AS int) AS v")
    assert table.append(many) == 3000
    few = spark.createDataFrame([(5, d("2024-01-01"), 9), (7, None, 9), (7, d("2024-01-01"), 9), (None, None, 1), (None, None, 2), (99999, None, 3)], schema)
    touched = table.may_hold(few.withColumn("key_bucket", table.bucket()))
    opened = touched.select(F.input_file_name()).distinct().count()
    assert 0 < opened <= 6 and table.stored().select(F.input_file_name()).distinct().count() == 64
    assert table.append(few, [F.col("v")]) == 3
    assert table.append(few) == 0 and table.append(many.limit(0)) == 0
    got = {tuple(r) for r in table.read().filter("k IS NULL OR k IN (5, 7, 99999)").collect()}
    assert got == {(5, d("2024-01-01"), 5), (7, None, 7), (7, d("2024-01-01"), 9), (None, None, 1), (99999, None, 3)}
    small = table.compact(fresh_folder(spark, "compact"))
    assert small.read().count() == 3003 and len(small.stored().inputFiles()) <= 64
    assert small.append(few) == 0


def test_tables_become_visible_together(spark):
    ledger = Ledger(spark, fresh_folder(spark, "ledger"), {"a": "x long", "b": "y string"})
    assert ledger.read("a").count() == ledger.read("b").count() == 0
    rows_a, rows_b = spark.range(3).toDF("x"), spark.range(2).selectExpr("cast(id AS string) AS y")

    def broken():
        raise RuntimeError("source closed")

    with pytest.raises(RuntimeError):
        ledger.write("one", {"a": lambda: rows_a, "b": broken})
    with pytest.raises(ValueError):
        ledger.commit(ledger.begin(), "one", ["a"])
    assert ledger.read("a").count() == 0
    ledger.write("one", {"a": lambda: rows_a, "b": lambda: rows_b})
    ledger.write("two", {"b": lambda: rows_b, "a": lambda: rows_a.filter("x > 5")})
    assert (ledger.read("a").count(), ledger.read("b").count()) == (3, 4)
    assert {(r.block, tuple(r.tables)) for r in ledger.commits().collect()} == {("one", ("a", "b")), ("two", ("a", "b"))}


def test_ballot_days_replace_themselves(spark):
    path = fresh_folder(spark, "t")
    df = spark.createDataFrame([("x", d("2024-01-01")), ("y", d("2024-01-02"))], "ballot_id string, ballot_date date")
    sinks.write_ballot_days(df, path)
    sinks.write_ballot_days(df.filter("ballot_id = 'y'").withColumn("ballot_id", F.lit("z")), path)
    assert {r.ballot_id for r in spark.read.parquet(path).collect()} == {"x", "z"}


def test_fingerprint_ignores_order_and_sees_changes(spark):
    df = spark.range(100).selectExpr("id", "cast(id % 7 AS string) AS s")
    same = df.orderBy(F.col("id").desc()).repartition(5).select("s", "id")
    first = sinks.section_fingerprint(df).first()
    assert first == sinks.section_fingerprint(same).first()
    assert first.fingerprint != sinks.section_fingerprint(df.withColumn("s", F.when(F.col("id") == 3, None).otherwise(F.col("s")))).first().fingerprint


def test_release_and_registry(spark):
    folder = fresh_folder(spark, "release")
    made = sinks.write_release({"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("y")}, folder, "v1")
    assert {r.section: r.n_rows for r in made.collect()} == {"a": 3, "b": 2}
    assert sinks.register_release(made, f"{folder}/registry") == 1
    assert sinks.register_release(made, f"{folder}/registry") == 0


def test_new_groups_and_links(spark, rows):
    facts = spark.createDataFrame([("g1",), ("g2",), ("g2",), (None,)], "group_ext_id string")
    got = sinks.new_group_keys(facts, spark.createDataFrame([("g1",)], "group_ext_id string"), "lower", 19)
    assert [r.group_ext_id for r in got.collect()] == ["g2"]
    parties = spark.createDataFrame([(["a", "b"], d("2022-09-25"), "h")], "parties array<string>, election date, sha256 string")
    readings = spark.createDataFrame([("d1", "h", 1), ("d2", "h", 2)], "document_id string, sha256 string, extraction int")
    assert rows(sinks.programme_links(parties, readings)) == [("a", d("2022-09-25"), "d2"), ("b", d("2022-09-25"), "d2")]


def test_saved_documents_once(spark):
    folder = fresh_folder(spark, "docs")
    docs = spark.createDataFrame([("h", 1)], "sha256 string, extraction int")
    pars = spark.createDataFrame([("h", 1, 0, "x"), ("h", 1, 1, "y")], "sha256 string, extraction int, n int, text string")
    assert sinks.save_documents(docs, pars, folder) == (1, 2)
    assert sinks.save_documents(docs, pars, folder) == (0, 0)


def test_quality_reasonless_and_coverage(spark, rows):
    ex = spark.createDataFrame([("a", " "), ("b", "ok")], "ballot_id string, reason string")
    assert rows(Q.reasonless(ex, ["ballot_id"])) == [("exclusion_without_reason", "a", "")]
    need, have = spark.createDataFrame([("a",), ("b",)], "party_id string"), spark.createDataFrame([("a",)], "party_id string")
    assert rows(Q.missing_coverage(need, have, ["party_id"], "programme_missing")) == [("programme_missing", "b", "missing")]


# ---- streams --------------------------------------------------------------------------------------------------------


def test_windowed_counts(spark):
    folder = fresh_folder(spark, "in")
    start = datetime(2024, 1, 1)
    made = [(start + timedelta(minutes=20 * i), "s") for i in range(12)]
    spark.createDataFrame(made, "ts timestamp, source string").coalesce(1).write.parquet(folder)
    out = fresh_folder(spark, "out")
    q = I.windowed_counts(I.landed(spark, folder, "ts timestamp, source string"), "ts", "source", "1 hour", "0 seconds")
    run = q.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
    run.awaitTermination()
    assert [r.n for r in spark.read.parquet(out).orderBy("window_start").collect()] == [3, 3, 3]


def accepted_by_hand(rows_, limit, span):
    kept, out = {}, set()
    for key, ident, at in sorted(rows_, key=lambda r: (r[2], r[1])):
        times = [t for t in kept.get(key, []) if t > at - span]
        if len(times) < limit:
            times.append(at)
            out.add(ident)
        kept[key] = times
    return out


def test_sender_limit_equals_a_plain_loop(spark):
    rnd = random.Random(3)
    start = datetime(2024, 1, 1)
    made = [(i, "/p", "long enough text", "", "hot" if i % 3 == 0 else f"o{rnd.randrange(5)}", None, start + timedelta(seconds=rnd.randrange(6 * 3600))) for i in range(200)]
    made += [(900, "/p", "short", "", "x", None, start), (901, "/p", "long enough text", "", "x", "trap", start)]
    folder, out = fresh_folder(spark, "in"), fresh_folder(spark, "out")
    spark.createDataFrame(made, "report_id bigint, url string, text string, contact string, origin string, trap string, created_at timestamp").coalesce(1).write.parquet(folder)
    with RP.state_store(spark):
        stream = I.landed(spark, folder, "report_id bigint, url string, text string, contact string, origin string, trap string, created_at timestamp")
        run = RP.by_sender(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-c").trigger(availableNow=True).start()
        run.awaitTermination()
    got = {r.report_id for r in spark.read.parquet(out).filter("accepted").collect()}
    assert got == accepted_by_hand([(m[4], m[0], m[6]) for m in made if m[0] < 900], RP.PER_SENDER, RP.SENDER_SPAN)


def test_limits_over_several_batches_and_a_replay(spark):
    from tallyframe.streaming.limits import Limit

    rnd = random.Random(5)
    start = datetime(2024, 1, 1)
    made = []
    for i in range(600):  # a third of all reports from one sender, many in one second
        hot = i % 3 == 0
        made.append((i, "/p", "long enough text", "me", "hot" if hot else f"o{rnd.randrange(40)}", None, start + timedelta(seconds=60 * i + (0 if hot else rnd.randrange(50)), microseconds=rnd.randrange(1000))))
    made += [(1000 + j, "/p", "long enough text", "", None, None, made[300][6]) for j in range(9)]
    kind = "report_id bigint, url string, text string, contact string, origin string, trap string, created_at timestamp"
    sender, day = Limit("sender_limit", 3, 3600), Limit("day_limit", 20, 7200)
    folder, out = fresh_folder(spark, "in"), fresh_folder(spark, "out")
    write = RP.into_reports(out, sender, day)
    made.sort(key=lambda m: m[6])
    for batch, at in enumerate(range(0, len(made), 203)):
        frame = spark.createDataFrame(made[at : at + 203], kind)
        write(frame, batch)
        write(frame.repartition(3), batch)  # a batch that runs again gives the same
    second = lambda m: int((m[6] - start).total_seconds())
    first = accepted_by_hand([(m[4], m[0], second(m)) for m in made], 3, 3600)
    want = accepted_by_hand([("all", m[0], second(m)) for m in made if m[0] in first], 20, 7200)
    got = spark.read.parquet(f"{out}/accepted")
    assert {r.report_id for r in got.collect()} == want and got.count() == len(want)
    told = {r.report_id: r.verdict for r in spark.read.parquet(f"{out}/verdicts").collect()}
    assert told == {m[0]: "accepted" if m[0] in want else "day_limit" if m[0] in first else "sender_limit" for m in made}
    assert 0 < len(want) < len(first) < len(made)


def test_blocks_resume_where_they_stopped(spark):
    folder = fresh_folder(spark, "blocks")
    I.land_blocks(spark.range(100).toDF("x"), f"{folder}/landed", "x", 5)
    rows_ = I.landed(spark, f"{folder}/landed", "x long", "*.parquet", files_per_trigger=1)
    table, seen, fail = I.into_table(f"{folder}/table", ["x"]), [], [True]

    def write(batch, batch_id):
        seen.append(batch_id)
        table(batch, batch_id)
        if batch_id == 3 and fail:
            fail.clear()
            raise ConnectionError("gone")

    assert "gone" in I.run_blocks(rows_, write, f"{folder}/c")
    assert seen == [0, 1, 2, 3]
    assert I.run_blocks(rows_, write, f"{folder}/c") is None
    assert seen == [0, 1, 2, 3, 3, 4]
    assert sorted(r.x for r in KeyedTable(spark, f"{folder}/table", "x long", ["x"]).read().collect()) == list(range(100))


def test_a_broken_release_is_not_declared(spark):
    from tallyframe.operators import bundle as BU

    folder = fresh_folder(spark, "bundle")
    made = {
        "subjects": spark.createDataFrame([("p1", "party", None), ("m1", "person", "p1")], "id string, kind string, party_id string"),
        "questions": spark.createDataFrame([("q1",)], "id string"),
        "positions": spark.createDataFrame([("m1", "q1")], "subject_id string, statement_id string"),
        "series": spark.createDataFrame([("p1", "m", d("2024-01-01"), 1, 2)], "party_id string, metric string, quarter date, n long, d long"),
        "seats": spark.createDataFrame([("lower", "p1", 3), ("lower", "total", 3)], "chamber string, holder string, seats long"),
        "programmes": spark.createDataFrame([("p1", 1, 4, 2, 3)], "party_id string, document_id long, promises long, precise long, t0 long"),
        "corrections": spark.createDataFrame([("x", "typo")], "object string, reason string"),
    }
    assert BU.publish(made, folder, "v1", {"positions": True}, ["t0"]).count() == 7
    bad = {
        "subjects": ("party_of_subject", made["subjects"].filter("id = 'm1'")), "questions": ("section_without_rows", made["questions"].limit(0)),
        "positions": ("subject_of_position", spark.createDataFrame([("zz", "q1")], "subject_id string, statement_id string")),
        "seats": ("seats_vs_total", made["seats"].withColumn("seats", F.when(F.col("holder") == "total", 9).otherwise(3))),
        "programmes": ("themes_over_promises", made["programmes"].withColumn("t0", F.lit(5))), "corrections": ("correction_without_reason", made["corrections"].withColumn("reason", F.lit(None).cast("string"))),
    }
    for i, (name, (check, rows_)) in enumerate(bad.items()):
        with pytest.raises(BU.BrokenRelease):
            BU.publish({**made, name: rows_}, folder, f"bad{i}", {"positions": True}, ["t0"])
        assert check in {r.check for r in BU.violations({**made, name: rows_}, {"positions": True}, ["t0"]).collect()}
        with pytest.raises(Exception):
            spark.read.json(f"{folder}/bad{i}/manifest").count()
    with pytest.raises(BU.BrokenRelease):
        BU.publish({k: v for k, v in made.items() if k != "seats"}, folder, "short", {}, ["t0"])
