"""Every query over the documents with awkward rows, against its SQL; and over empty tables."""

from __future__ import annotations

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry_points
import check_queries

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
ON_DOCUMENTS = [
    "op2_host_rules", "op3_sharding", "op4_mixing", "op5_licenses", "op7_line_spread", "op8_jaccard_join",
    "op9_decontamination", "op10_shared_spans", "op12_hard_negatives", "op11_collocations", "op13_personal_data",
]
WITHOUT_SQL = ["op1_transcripts", "op6_interpolation"]
VOCABULARY = ["ba", "Ka", "lo", "été", "mi9", "nu", "po", "ruß", "sa", "tö", "vi", "wo"]


# Texts with personal data, and with what only looks like it
PERSONAL = [
    "mail a.b+c@mail.example.com, x@y, a@b.c@d.e and a@b.cc_x@d.ee. @x.yz q@-.- é@é.com", "@" * 50 + "a@b.c", "a" * 3000 + "@b.c" + ".d" * 3000,
    "1.2.3.4.5.6.7.8 and 256.1.1.1 or 0001.002.03.4 1.2.3 01.02.03.999999999999999999999999 9.9.9.9", "1" * 5000 + ".2.3.4", "5.5.5.5",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111  1111 1111 1111; 4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "4111111111111111", " 4111111111111111 ",
    "x4111111111111111y 41111111111111111111111 5500005555555559", "1 " * 6000, "1" * 20000, "-4111111111111111-",
    "+1 (958) 555-1150 +44 20 7946 0958. +12345678 +1 +((( ++49 (0)30 123456-78 +1()", "+1" + "(" * 3000, "+1 (999) 555-0000+1 (999) 555-0001",
    "IBAN GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765432, GB82WEST12345698765431 and XGB82WEST12345698765432 DE89370400440532013000.",
    "ssn 123-45-6789, 123-45-6789 of a test, social security 987-65-4321 and 000-12-3456", "ssn 123-45-67890 no 1123-45-6789", "123-45-6789",
    "é 😀 a@b.cd 😀 +1 (958) 555-1150 ü", "NL91ABNA0417164300FR1420041010050500013M02606", "\n\n4111\n1111 1111 1111 1111",
]


def prose(rng: random.Random, n: int, line: int = 12) -> str:
    words = [rng.choice(VOCABULARY) + rng.choice(VOCABULARY) for _ in range(n)]
    return "\n".join(" ".join(words[i : i + line]) for i in range(0, n, line))


def awkward() -> list[tuple]:
    rng = random.Random(7)
    item = "One two three four five six seven eight nine ten eleven twelve"
    copy = prose(rng, 120)
    near = copy.split(" ")
    rows = [
        (1, None, "s1"), (2, "", "s1"), (3, " \t\n\x0b ", None), (4, "word", "s2"), (4, "word", "s2"), (None, "no id here", "s2"),
        (None, None, None), (5, "a b c d e f", "s3"), (5, "another text of the same id", "s3"), (6, copy, "s1"), (7, copy, "s2"), (7, copy, "s2"),
        (8, " ".join(near[:60] + ["changed"] + near[61:]), "s3"), (9, prose(rng, 20_000), "s4"), (10, "x" * 3000, "s1"), (11, "ab" * 700, "s2"),
        (12, f"start {item.upper()} end", "s1"), (13, "short item", "s2"), (14, item.replace(" ", "-"), "s3"),
        (15, "All rights reserved.\nReleased under the MIT License.\ncc by cc by", "s1"), (16, "CC-BY\nGNU General Public License\n\n\n", "s4"),
        (17, "### *** $$$ %%% " * 30, "s5"), (18, "same line\n" * 40, "s5"), (19, "tri gram here " * 40, "s5"), (-20, "negative id", "s5"),
        (1 << 40, prose(rng, 60), "sé"), (21, " non breaking  spaces", "s6"), (22, "nul\x00byte and \x1f control", "s6"),
        (23, "é combining ß ẞ İ ı", "s6"),
    ]
    rows += [(300 + i, text, "pii") for i, text in enumerate(PERSONAL)]
    # the same line on many sites, and near copies of a group
    rows += [(100 + i, f"Shared footer line\nown words {i} " + prose(rng, 30), f"site{i}") for i in range(14)]
    base = prose(rng, 80).split(" ")
    for i in range(45):
        text = list(base)
        for _ in range(i % 4):
            text[rng.randrange(len(text))] = f"v{rng.randrange(9)}"
        rows.append((200 + i, " ".join(text), "copies"))
    return rows


def tables(folder, rows: list[tuple], items: list[tuple], said: list[tuple]) -> str:
    ids, texts, sources = ([r[k] for r in rows] for k in range(3))
    documents = pa.table({
        "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array([(None, "und", "xx", "yy", "")[i % 5] for i in range(len(rows))], pa.string()),
        "source": pa.array(sources, pa.string()), "n_chars": pa.array([0] * len(rows), pa.int64()),
        # names that the operators might use for themselves
        **{c: pa.array([c] * len(rows), pa.string()) for c in ("measure", "verdict", "set_key", "hits", "times", "n_words", "size", "shard", "host_verdict", "kept")},
    })
    pq.write_table(documents, f"{folder}/documents.parquet")
    pq.write_table(pa.table({"item_id": pa.array([i for i, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string())}), f"{folder}/benchmark.parquet")
    pq.write_table(pa.table({
        "conv_id": pa.array([x[0] for x in said], pa.int64()), "turn": pa.array([x[1] for x in said], pa.int64()),
        "role": pa.array([x[2] for x in said], pa.string()), "text": pa.array([x[3] for x in said], pa.string()),
    }), f"{folder}/conversations.parquet")
    vectors = VECTORS if rows else []
    pq.write_table(pa.table({
        "vec_id": pa.array([v[0] for v in vectors], pa.int64()), "label": pa.array([v[1] for v in vectors], pa.int32()),
        "embedding": pa.array([v[2] for v in vectors], pa.list_(pa.float32())), "score": pa.array([0] * len(vectors), pa.int64()), "block": pa.array(["x"] * len(vectors)),
    }), f"{folder}/embeddings.parquet")
    return str(folder)


def vectors() -> list[tuple]:
    rng = random.Random(12)
    made = [(i, rng.randrange(4), [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)]
    made += [(1000 + i, 1, made[0][2]) for i in range(40)]  # copies, ids divisible by 100 among them
    made += [(200, 2, made[200][2]), (300, 3, [0.0] * 6), (None, 1, made[5][2]), (None, 0, made[5][2]), (-100, 1, [-x for x in made[0][2]])]
    nan, inf = float("nan"), float("inf")
    made += [(2000, None, [1.0] * 6), (2100, 1, None), (2200, 1, [1.0, None]), (2300, 1, [nan] * 6), (2400, 1, [inf] * 6), (2500, 1, []), (2600, 1, [1.5]), (2700, 1, [3e9] * 6)]
    return [*made, (2800, 99, [1.0] * 6)]  # an anchor alone with its label


VECTORS = vectors()

ITEMS = [
    (1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short ITEM"), (3, ""), (4, None), (None, "no id here"),
    (11, "one two three four five six seven eight nine ten and other words"), (5, "..."),
]
SAID = [
    (1, 0, "user", "Hello?\nmore"), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (None, 0, "user", "alone"), (None, None, None, None),
    (2, None, "tool", "odd role"), (2, 5, None, "no role"), (3, 0, "system", ""), (4, 0, "user", "long " * 5000), (4, 70, "assistant", "second part"),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("awkward"), awkward(), ITEMS, SAID)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return tables(tmp_path_factory.mktemp("empty"), [], [], [])


def wanted(folder: str, sql: str):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    return check_queries.rows(names, cur.fetchall())


@pytest.mark.parametrize("name", ON_DOCUMENTS)
def test_awkward_rows(spark, folder, name):
    df = QUERIES[name](spark, folder)
    assert check_queries.rows(df.columns, df.collect()) == wanted(folder, ORACLES[name])


@pytest.mark.parametrize("name", [*ON_DOCUMENTS, *WITHOUT_SQL, "pipeline"])
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).count() == 0


def test_awkward_rows_without_sql(spark, folder):
    assert QUERIES["op6_interpolation"](spark, folder).count() == len(awkward())
    assert QUERIES["op1_transcripts"](spark, folder).count() == 6


def test_pipeline_stages_keep_columns(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() > 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


def plain_removed(texts: list[str]) -> list[tuple[int, int]]:
    """(removed, spans) by looking at every string."""
    from collections import Counter

    size, raw = 200, [t.encode() for t in texts]
    times = Counter(t[i : i + size] for t in raw for i in range(len(t) - size + 1))
    out = []
    for t in raw:
        gone = [False] * len(t)
        for i in range(len(t) - size + 1):
            if times[t[i : i + size]] > 1:
                gone[i : i + size] = [True] * size
        out.append((sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))))
    return out


def test_shared_spans_without_and_around_the_limit(spark):
    from tallyframe.llm import shared_spans

    rng = random.Random(3)
    made = lambda n: "".join(rng.choice("abcdefg hij") for _ in range(n))
    part = made(150)
    for texts in (
        [made(300) + part + made(300), made(300) + part + made(300)],  # anchors are shared, no string is
        [made(700), made(650)],
        *[[made(120) + "X" + shared + "Y" + made(90), made(60) + "Z" + shared + "W" + made(240)] for n in (198, 199, 200, 201) for shared in [made(n)]],
        [made(40) + made(8) * 60 + made(400)],
    ):
        rows = shared_spans.without_shared_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
        assert [(r["n_removed"], r["n_spans"]) for r in rows] == plain_removed(texts)
