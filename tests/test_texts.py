from __future__ import annotations

import random
from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import text as X
from tallyframe.functions import urls as U
from tallyframe.operators import collection as CO
from tallyframe.operators import documents as D
from tallyframe.params import DEFAULT
from tallyframe.sources import pages as PG


def apply(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text, expected", [
    ("  a​ b \t c  \n\n\n\n d ", "a b c\n\nd"), ("ﬁne x", "fine x"), ("a\x07b", "ab"), (None, ""), ("‮abc­", "abc"),
])
def test_clean_text(spark, text, expected):
    assert apply(spark, text, X.clean_text) == expected


def test_quote_form(spark):
    assert apply(spark, "«Più  lavoro – meno tasse» , dice", X.quote_form) == '"più lavoro-meno tasse", dice'
    assert apply(spark, "Straße ( x )", X.quote_form) == "strasse (x)"


@pytest.mark.parametrize("title, expected", [
    ("Legge &amp;quot;Rossi&amp;quot;^^http://www.w3.org/2001/XMLSchema#string", 'Legge "Rossi"'), ("<em>Citt&agrave;</em>  nuove", "Città nuove"), ("  ", None),
])
def test_clean_title(spark, title, expected):
    assert apply(spark, title, X.clean_title) == expected


@pytest.mark.parametrize("a, b", [
    ("Misure urgenti (approvato dal Senato) (1551)", "S. 899. - Misure urgenti"),
    ("Conversione del decreto-legge 1° marzo 2024, n. 12, recante x", "Legge sul decreto-legge 1 marzo 2024, n.12"),
])
def test_law_key_joins_the_chambers(spark, a, b):
    assert apply(spark, a, X.law_key) == apply(spark, b, X.law_key)


@pytest.mark.parametrize("url, expected", [
    ("HTTPS://WWW.Sito.IT/A?utm_source=x&b=2#top", "https://www.sito.it/A?b=2"), ("https://sito.it/a?utm_medium=x", "https://sito.it/a"),
    ("https://sito.it/a?x=&y", "https://sito.it/a?x=&y="), (" https://sito.it ", "https://sito.it"),
])
def test_normal_url(spark, url, expected):
    assert apply(spark, url, U.normal_url) == expected


@pytest.mark.parametrize("link, expected", [
    ("/a/b", "https://s.it/a/b"), ("c", "https://s.it/x/c"), ("../c", "https://s.it/c"), ("./d?q", "https://s.it/x/d?q"), ("//t.it/z", "https://t.it/z"),
    ("?p=2", "https://s.it/x/y?p=2"), ("http://o.it", "http://o.it"), ("", "https://s.it/x/y"),
])
def test_resolve(spark, link, expected):
    assert apply(spark, link, lambda c: U.resolve(F.lit("https://s.it/x/y"), c)) == expected


FORMS = {"bianchi": ["Anna Bianchi"], "rossi": ["Mario Rossi", "l’onorevole Rossi"]}


@pytest.mark.parametrize("text, found, named", [
    ("ieri MARIO ROSSI e Anna Bianchi", ["bianchi", "rossi"], True), ("Mario Rossini", [], False), ("l'onorevole Rossi", ["rossi"], True),
    ("parla Rossi oggi", [], True), ("fatti rossi", [], False), ("èMario Rossi", [], True), ("èMario Rossini", [], False),
])
def test_mentions(spark, text, found, named):
    assert apply(spark, text, lambda c: X.mentions(c, FORMS)) == found
    assert apply(spark, text, lambda c: X.names_anyone(c, FORMS, ["Rossi"])) is named


@pytest.mark.parametrize("horizon, measure, quote, expected", [
    ("entro il 2027", "20.000 insegnanti", "", True), ("entro la legislatura", "10 miliardi", "", True), ("al più presto", "10 miliardi", "", False),
    ("in tre anni", "riforma del 2026", "", False), ("in tre anni", "riforma", "5 ospedali", True), (None, "10", "", False),
])
def test_precise(spark, horizon, measure, quote, expected):
    df = spark.createDataFrame([(horizon, measure, quote)], "h string, m string, q string")
    assert df.select(X.is_precise(F.col("h"), F.col("m"), F.col("q")).alias("x")).first().x is expected


@pytest.mark.parametrize("value, expected", [('{"testo": "a"}', "a"), ('"b"', "b"), ('{"x": 1}', '{"x": 1}'), ("3", "3")])
def test_json_in_words(spark, value, expected):
    assert apply(spark, value, X.json_in_words) == expected


@pytest.mark.parametrize("page, expected", [
    ("Una riga lunga che va a capo e pro-\nsegue qui fino alla fine.\nCorta.\nUn altro paragrafo che comincia qui", [
        "Una riga lunga che va a capo e prosegue qui fino alla fine.", "Corta.", "Un altro paragrafo che comincia qui"]),
    ("Prima riga del testo abbastanza lunga\n\nDopo la riga vuota", ["Prima riga del testo abbastanza lunga", "Dopo la riga vuota"]),
    ("Elenco:\n• uno\n• due", ["Elenco:", "• uno", "• due"]),
    ("TITOLO BREVE\nUna riga lunga quanto serve per essere piena davvero", ["TITOLO BREVE", "Una riga lunga quanto serve per essere piena davvero"]),
    ("", []), ("x", []),
])
def test_paragraphs(spark, page, expected):
    assert apply(spark, page, D.paragraph_texts) == expected


def test_paragraph_runs_on_to_the_next_page(spark, rows):
    df = spark.createDataFrame(
        [("d", 1, 0, "Primo.", False), ("d", 1, 1, "continua", False), ("d", 2, 0, "nella pagina", True), ("d", 2, 1, "Altro", False)],
        "document_id string, page int, n int, text string, reread boolean",
    )
    assert rows(D.document_paragraphs(df)) == [
        ("d", 1, 1, "Primo.", False), ("d", 2, 1, "continua nella pagina", True), ("d", 3, 2, "Altro", False)]


def test_reading_noise(spark, rows):
    words = spark.createDataFrame([("secondo",), ("costituzione",), ("tutela",)], "word string")
    made = [("EH secondo Costituzione", True), ("Nb", True), ("YA ji kkk", True), ("La tutela", True), ("zz", False)]
    df = spark.createDataFrame([("d", 1, i, t, r) for i, (t, r) in enumerate(made)], "document_id string, page int, n int, text string, reread boolean")
    assert [r[3] for r in rows(D.without_reading_noise(df, words).orderBy("n"))] == ["secondo Costituzione", "La tutela", "zz"]


def test_greedy_batches(spark, rows):
    df = spark.createDataFrame([("d", i, "x" * n) for i, n in enumerate([5, 5, 30, 3, 3])], "document_id string, n int, text string")
    assert [b for _, _, b in rows(D.greedy_batches(df, replace(DEFAULT, batch_chars=10)))] == [0, 0, 1, 2, 2]


def test_quotes(spark):
    pars = spark.createDataFrame([("d", 1, "Aumentare le pensioni -"), ("d", 2, "minime a mille euro"), ("d", 3, "fine del testo lungo")], "document_id string, n int, text string")
    claims = spark.createDataFrame([
        ("d", 1, "“le pensioni – minime a mille”", "m"), ("d", 2, "le pensioni-minime a mille", "M "), ("d", 3, "mille euro", "m"),
        ("d", 4, "non c'è nel documento", "m"), ("d", 5, "minime a mille euro", ""), ("z", 6, "altro documento qui", "m"),
    ], "document_id string, ord int, quote string, measure string")
    got = {r.ord: (r.outcome, r.para_from, r.para_to) for r in D.verify_quotes(claims, pars).collect()}
    assert got == {1: ("kept", 1, 2), 2: ("repeated", None, None), 3: ("quote_not_found", None, None), 4: ("quote_not_found", None, None),
                   5: ("measure_empty", None, None), 6: ("quote_not_found", None, None)}


def brute_shared(docs):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[i:i + 6]) for i in range(len(w) - 5)}
    out = set()
    for i, p, t in docs:
        for _, q, u in docs:
            a, b = grams(t), grams(u)
            if t != u and p != q and a and b and 2 * len(a & b) > min(len(a), len(b)):
                out.add((i, p, q))
    return sorted(out)


def test_shared_text_equals_brute_force_with_a_hot_group(spark):
    import random
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rnd.choice(vocabulary) for _ in range(40)]
    docs = []
    for i in range(60):
        kind = i % 3
        if kind == 0:  # near-copies of one text: a third of all documents
            t = list(base)
            for _ in range(i % 4):
                t[rnd.randrange(40)] = rnd.choice(vocabulary)
        elif kind == 1:  # half of the text is shared boilerplate
            t = base[: rnd.choice([18, 22, 26])] + [rnd.choice(vocabulary) for _ in range(rnd.choice([10, 16, 24]))]
        else:
            t = [rnd.choice(vocabulary) for _ in range(rnd.choice([4, 12, 50]))]
        docs.append((i, f"p{rnd.randrange(5)}", " ".join(t)))
    docs += [(100, "p0", docs[0][2]), (101, "p1", docs[0][2])]
    df = spark.createDataFrame(docs, "document_id int, party_id string, text string")
    assert sorted(map(tuple, D.shared_text(df).collect())) == brute_shared(docs)


def test_readability_uses_the_worst_window(spark):
    known = spark.createDataFrame([("parola",)], "word string")
    texts = spark.createDataFrame([(1, "parola " * 40), (2, "parola " * 40 + "iientia " * 6 + "parola " * 40), (3, "parola " * 4 + "iientia")], "doc_id int, text string")
    got = {r.doc_id: (r.worst, r.readable) for r in D.readability(D.document_words(texts, "doc_id"), "doc_id", known).collect()}
    assert got == {1: (20, True), 2: (14, False), 3: (4, True)}


def test_main_text_drops_hidden_elements(spark):
    html = ('<html><head><title>T &amp; t</title><meta name="date" content="2026-10-01"></head><body><nav>menu</nav><article><p>Testo '
            '<span style="display: none">nascosto</span><b>visibile</b></p><div hidden><p>no</p></div><img src=x hidden><p>fine</p></article></body></html>')
    row = PG.main_text(spark.createDataFrame([(1, "https://s.it", html), (2, "u", None)], "page_id bigint, url string, html string")).orderBy("page_id").first()
    assert (row.title, row.text, row.date, row.reserved) == ("T & t", "Testo visibile\n\nfine", "2026-10-01", False)


def test_decode(spark):
    def read(b):
        return spark.createDataFrame([(bytearray(b),)], "b binary").select(PG.decode(F.col("b")).alias("x")).first().x
    assert read("perché".encode()) == "perché"
    assert read("perché".encode("cp1252")) == "perché"
    assert read('<meta charset="iso-8859-1">perché'.encode("latin1")).endswith("perché")
    assert read('<meta charset="nobody-knows">perché'.encode()).endswith("perché")
    assert read(b"<!--" + b"x" * 9000 + b'--><meta charset="latin1"></head>' + "perché".encode("latin1")).endswith("perché")


def test_law_key_has_no_limit(spark):
    a, b = "parola " * 40 + "uno", "parola " * 40 + "due"
    got = spark.createDataFrame([(a,), (b,)], "t string").select(X.law_key(F.col("t"))).distinct().count()
    assert got == 2


def test_sitemap(spark, rows):
    xml = ('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://S.it/news/1?utm_x=1</loc><lastmod>2026-10-01</lastmod></url>'
           "<url><loc>https://s.it/news/2</loc></url><url><loc>https://s.it/other</loc><lastmod>2026-10-02</lastmod></url></urlset>")
    got = PG.sitemap_links(spark.createDataFrame([("s", xml)], "source string, xml string"), "source", "/news/").orderBy("rank").collect()
    assert [(g.link, g.published_at) for g in got] == [("https://s.it/news/1", datetime(2026, 10, 1)), ("https://s.it/news/2", None)]


ELEMENTS = ("source string, level string, channel string, ord int, url string, title string, summary string, text string, "
            "published_at timestamp, reserved boolean")


def test_collection_policy(spark):
    made = [
        ("a", "C", "rss", 0, "https://a/1?utm_s=1", "Mario Rossi parla", None, "testo", None, False),
        ("a", "C", "rss", 1, "https://a/2", "Meteo", "sole", "Mario Rossi", None, False),
        ("a", "C", "rss", 2, "https://a/3", "Rossi in aula", None, "segreto", None, True),
        ("a", "C", "rss", 3, "https://a/1", "Mario Rossi parla", None, "testo", None, False),
        ("b", "A", "site", 0, "https://b/1", "Nota", None, "system prompt", None, True),
        ("b", "A", "site", 1, "https://b/old", "Nota", None, "x", None, False),
        ("c", "C", "site", 0, "https://c/1", "Mario Rossi parla", None, "testo", None, False),
    ]
    seen = spark.createDataFrame([("https://b/old",)], "url string")
    now = F.lit(datetime(2026, 10, 1))
    judged = CO.judge_documents(spark.createDataFrame(made, ELEMENTS), seen, CO.Names({"rossi": ["Mario Rossi"]}, ["Rossi"]), now)
    assert {(r.source, r.ord): r.outcome for r in judged.collect()} == {
        ("a", 0): "stored", ("a", 1): "outside", ("a", 2): "stored", ("a", 3): "duplicate", ("b", 0): "stored", ("b", 1): "seen", ("c", 0): "duplicate"}
    stored = {(r.source, r.url): r for r in CO.stored_documents(judged).collect()}
    assert stored["a", "https://a/1"].subjects == ["rossi"] and stored["a", "https://a/1"].text_expires_at == datetime(2026, 10, 8)
    assert stored["a", "https://a/3"].text is None and stored["a", "https://a/3"].text_expires_at is None
    assert stored["b", "https://b/1"].text == "system prompt" and stored["b", "https://b/1"].suspicious == "system prompt"


def test_every_listed_element_is_judged(spark):
    made = [("s", "A", "site", i, f"https://s/{i}", f"t{i}", None, f"x{i}", None, False) for i in range(35)]
    judged = CO.judge_documents(spark.createDataFrame(made, ELEMENTS), spark.createDataFrame([], "url string"), CO.Names({"r": ["Mario Rossi"]}), F.current_timestamp())
    assert judged.filter("outcome = 'stored'").count() == 35


def test_retention_at_exactly_seven_days(spark):
    made = [(1, "a", datetime(2026, 10, 8), None), (2, "b", datetime(2026, 10, 8, 0, 0, 1), None), (3, None, None, datetime(2026, 1, 1))]
    df = spark.createDataFrame(made, "id int, text string, text_expires_at timestamp, text_cleared_at timestamp")
    now = F.lit(datetime(2026, 10, 8))
    once = CO.retention(df, now)
    got = {r.id: (r.text, r.text_cleared_at) for r in once.collect()}
    assert got == {1: (None, datetime(2026, 10, 8)), 2: ("b", None), 3: (None, datetime(2026, 1, 1))}
    assert sorted(map(tuple, CO.retention(once, now).collect()), key=repr) == sorted(map(tuple, once.collect()), key=repr)


def test_quotations_of_a_document_in_one_pass(spark):
    rnd = random.Random(11)
    words_ = [rnd.choice(["alfa", "beta", "gamma", "delta", "epsilon", "zeta"]) for _ in range(400)]
    pars = [" ".join(words_[i : i + 20]) for i in range(0, 400, 20)]
    whole = " ".join(pars)
    starts = [sum(len(x) + 1 for x in pars[:k]) for k in range(len(pars))]
    claims = []
    for i in range(300):
        at = rnd.randrange(len(whole) - 40)
        size = rnd.choice([16, 30, 200])
        claims.append(("doc", i, whole[at : at + size], f"m{i}"))
    claims += [("doc", 900 + i, "omega " * 4 + str(i), "m") for i in range(5)] + [("other", 1, whole[:50], "m"), (None, 1, whole[:50], "m")]
    frame = spark.createDataFrame(claims, "document_id string, ord int, quote string, measure string")
    paragraphs = spark.createDataFrame([("doc", n, t) for n, t in enumerate(pars)] + [("second", 0, "nothing asked of it")], "document_id string, n int, text string")
    before, D.QUOTES_A_PASS = D.QUOTES_A_PASS, 50  # several passes over one document
    try:
        got = {(r.document_id, r.ord): (r.outcome, r.para_from, r.para_to) for r in D.verify_quotes(frame, paragraphs).collect()}
    finally:
        D.QUOTES_A_PASS = before
    assert len(got) == len(claims)
    for doc, ord_, quote, _ in claims:
        q = " ".join(quote.split())
        at = whole.find(q) if doc == "doc" else -1
        want = ("quote_not_found", None, None)
        if at >= 0 and len(q) >= 15:
            want = ("kept", max(k for k, s in enumerate(starts) if s <= at), max(k for k, s in enumerate(starts) if s < at + len(q)))
        assert got[doc, ord_] == want, quote


def test_readability_in_the_row_equals_the_join(spark, monkeypatch):
    rnd = random.Random(2)
    texts = [(i, " ".join(rnd.choice(["Parola", "città", "xyzzy", "di", "qwe", "perché"]) for _ in range(n))) for i, n in enumerate([0, 1, 5, 19, 20, 21, 60, 300])]
    texts += [(90, None), (91, "a b c"), (92, "xyzzy " * 40)]
    frame = spark.createDataFrame(texts, "doc_id int, text string")
    for known in (["parola", "citta", "perche"], ["nessuna"], []):
        dictionary = spark.createDataFrame([(w,) for w in known], "word string")
        rows_ = sorted(map(tuple, D.readable_texts(frame, "doc_id", dictionary).collect()))
        want = sorted(map(tuple, D.readability(D.document_words(frame, "doc_id"), "doc_id", dictionary).collect()))
        assert rows_ == want
        with monkeypatch.context() as m:
            m.setattr(D, "KNOWN_WORDS", 0)
            assert sorted(map(tuple, D.readable_texts(frame, "doc_id", dictionary).collect())) == want
