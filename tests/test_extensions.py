"""As-of lookups, claims, promises, identities and SQL functions against plain loops, with one hot key and odd rows."""

from __future__ import annotations

import random
from datetime import date, timedelta
from decimal import Decimal

from tallyframe.functions.catalog import register_party_at_date
from tallyframe.operators import asof as A
from tallyframe.operators import identity as ID
from tallyframe.operators import temporal as T

DAY0 = date(2020, 1, 1)


def day(n):
    return DAY0 + timedelta(days=n)


def test_nearest_equals_a_plain_search(spark):
    rnd = random.Random(4)
    keys = ["hot"] * 3 + ["a", "b", None]
    asks = [(i, rnd.choice([*keys, "nobody"]), None if i % 41 == 0 else day(rnd.randrange(900))) for i in range(400)]
    answers = [(rnd.choice(keys), None if i % 37 == 0 else day(rnd.randrange(100, 800)), rnd.randrange(50), f"n{i % 7}") for i in range(300)]
    ask_df = spark.createDataFrame(asks, "id int, series string, on_date date")
    answer_df = spark.createDataFrame(answers, "series string, on_date date, v int, name string")
    for forward in (False, True):
        for stretch in ("month", "year"):
            got = {r.id: None if r.hit is None else (r.hit.on_date, r.hit.v, r.hit.name) for r in A.nearest(ask_df, answer_df, "series", "on_date", "hit", forward, stretch).collect()}
            assert len(got) == len(asks)
            for i, key, at in asks:
                held = [(d, v, n) for k, d, v, n in answers if k is not None and k == key and d is not None and at is not None and (d >= at if forward else d <= at)]
                best = (min if forward else max)((d for d, _, _ in held), default=None)
                assert got[i] == max((h for h in held if h[0] == best), default=None), (i, forward)


def test_claims_are_judged_by_share_and_amount(spark):
    seen = spark.createDataFrame([("s", day(0), Decimal(100)), ("s", day(10), Decimal(0)), ("s", day(20), Decimal(200))], "series string, on_date date, value decimal(18,2)")
    units = spark.createDataFrame([("s", "one", "1"), ("s", "k", "1000")], "series string, unit string, factor string")
    rows = [
        (1, "s", "level", day(0), day(5), Decimal(110), "one"), (2, "s", "level", day(0), day(5), Decimal("110.01"), "one"), (3, "s", "level", day(0), day(5), Decimal("120.01"), "one"),
        (4, "s", "level", day(0), day(12), Decimal(3), "one"), (5, "s", "level", day(0), day(12), Decimal(4), "one"), (6, "s", "change", day(0), day(25), Decimal(100), "one"),
        (7, "s", "level", day(0), day(25), Decimal("0.2"), "k"), (8, "s", "level", day(0), day(25), Decimal(1), "percent"), (9, "s", "level", day(0), day(-3), Decimal(1), "one"),
        (10, "x", "level", day(0), day(25), Decimal(1), "one"), (11, "s", "other", day(0), day(25), Decimal(1), "one"), (12, "s", "change", day(-9), day(25), Decimal(1), "one"),
        (13, "s", "level", day(0), day(25), None, "one"),
    ]
    claims = spark.createDataFrame(rows, "id int, series string, kind string, since date, until date, declared decimal(18,4), unit string")
    made = A.judged_claims(claims, seen, units, {"level": A.Tolerance("0.1", "3"), "change": A.Tolerance("0.5")})
    got = {r.id: (r.outcome, r.rule) for r in made.collect()}
    missing, mismatch = ("unverifiable", "series_missing"), ("unverifiable", "unit_mismatch")
    assert got == {
        1: ("supported", "within"), 2: ("imprecise", "within_double"), 3: ("contradicted", "beyond"), 4: ("supported", "within"), 5: ("contradicted", "beyond"),
        6: ("supported", "within"), 7: ("supported", "within"), 8: mismatch, 9: missing, 10: missing, 11: missing, 12: missing, 13: ("contradicted", "beyond"),
    }


def test_promise_status(spark):
    acts = spark.createDataFrame([
        ("w", "law1", day(50), True, False), ("w", "law0", day(5), True, False), ("p", "part1", day(40), True, True), ("x", "no", day(40), False, False), ("b", "part2", day(20), True, True), ("b", "law2", day(60), True, False),
    ], "topic string, act_id string, act_date date, approved boolean, partial boolean")
    votes = spark.createDataFrame([("law1", "against", True), ("law1", "for", False)], "act_id string, party_id string, against boolean")
    rows = [(1, "for", "w"), (2, "against", "w"), (3, "for", "p"), (4, "for", "x"), (5, "for", "b"), (6, "for", None)]
    promises = spark.createDataFrame([(i, p, t, day(10), day(100), True) for i, p, t in rows] + [(7, "for", "w", day(10), day(49), True), (8, "for", "w", day(10), day(100), None), (9, "for", "w", day(50), day(50), True)],
                                     "promise_id int, party_id string, topic string, made_on date, until date, agreed boolean")
    got = {r.promise_id: (r.status, r.act_id) for r in A.promise_status(promises, acts, votes).collect()}
    assert got == {1: ("kept", "law1"), 2: ("not_kept", "law1"), 3: ("halfway", "part1"), 4: ("not_kept", None), 5: ("kept", "law2"), 6: ("not_kept", None),
                   7: ("not_kept", None), 8: ("to_verify", None), 9: ("kept", "law1")}


def test_two_identities_equal_a_count_of_days(spark):
    rnd = random.Random(9)
    rows = []
    for i in range(240):
        name = "hot" if i % 3 == 0 else f"n{rnd.randrange(30)}"
        start = rnd.randrange(1500)
        rows.append((name, f"id{rnd.randrange(60)}", None if i % 50 == 7 else day(start), None if i % 11 == 0 else day(start + rnd.randrange(-5, 200))))
    rows += [(None, "a", day(0), day(9)), (None, "b", day(0), day(9)), ("next", "a", day(0), day(9)), ("next", "b", day(10), day(19)), ("next", "c", day(9), day(10))]
    frame = spark.createDataFrame(rows, "name string, identity string, valid_from date, valid_to date")
    end = day(1800)
    want = {}
    for name in {r[0] for r in rows if r[0]}:
        for n in range(1801):
            active = {i for k, i, a, b in rows if k == name and a is not None and a <= day(n) <= (b or end)}
            if len(active) >= 2:
                want[name, day(n)] = len(active)
    got = {}
    found = ID.simultaneous(frame, "name", "identity", end.isoformat()).collect()
    for r in found:
        for k in range((r.valid_to - r.valid_from).days + 1):
            assert (r.name, r.valid_from + timedelta(days=k)) not in got
            got[r.name, r.valid_from + timedelta(days=k)] = r.identities
    assert got == want and "hot" in {r.name for r in found}


def test_linked_identities_equal_components(spark):
    rnd = random.Random(6)
    rows = [(i, "many" if i % 3 == 0 else f"f{rnd.randrange(200)}", f"c{rnd.randrange(150)}" if i % 4 == 0 else None) for i in range(300)]
    rows += [(1000 + i, f"chain{i // 2}", f"link{(i + 1) // 2}") for i in range(40)] + [(2000, None, None), (None, "many", None)]
    frame = spark.createDataFrame(rows, "id int, form string, code string")
    got = {r.id: r.person for r in ID.linked_identities(frame, "id", ["form", "code"]).collect()}
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for column in (1, 2):
        first = {}
        for r in rows:
            if r[0] is None or r[column] is None:
                continue
            a, b = root(r[0]), root(first.setdefault(r[column], r[0]))
            parent[max(a, b)] = min(a, b)
    assert got == {i: root(i) for i in parent}


def test_party_at_date_from_sql(spark):
    links = spark.createDataFrame([("g", "a", day(0), day(9)), ("g", "b", day(10), None), ("two", "a", day(0), None), ("two", "b", day(0), None)], "group_id string, party_id string, valid_from date, valid_to date")
    own = spark.createDataFrame([("p", "party", "c", day(0), None), ("q", "group", "d", day(0), None)], "person_id string, kind string, party_id string, valid_from date, valid_to date")
    facts = spark.createDataFrame([(p, g, day(n)) for p in ("p", "q", None) for g in ("g", "two", None) for n in (-1, 0, 9, 10)], "person_id string, group_id string, on_date date")
    register_party_at_date(spark, links, own, "party_then")
    got = spark.sql("SELECT person_id, group_id, on_date, party_then(person_id, group_id, on_date) AS party_id FROM {facts}", facts=facts)
    want = T.party_at_date(facts, links, own)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.select(*got.columns).collect()), key=repr)
