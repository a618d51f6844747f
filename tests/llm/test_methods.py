"""The operators' methods against plain computations on small inputs."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import collocations, decontamination, hard_negatives, interpolation, jaccard, licenses, line_spread, mixing, sharding, shared_spans, transcripts
from tallyframe.llm.components import components


def docs(spark, rows, columns="doc_id long, text string, source string"):
    return spark.createDataFrame(rows, columns)


# ---- near duplicates


def near_texts(seed: int):
    rng = random.Random(seed)
    texts = []
    for _ in range(6):
        base = [rng.choice("abcdefghijklmnop") + str(rng.randrange(60)) for _ in range(rng.randrange(8, 90))]
        for _ in range(rng.randrange(1, 30)):
            words = list(base)
            for _ in range(rng.randrange(0, 1 + len(words) // 10)):
                words[rng.randrange(len(words))] = "n" + str(rng.randrange(500))
            texts.append(" ".join(words))
    # a passage that many otherwise different texts share
    passage = [f"p{i}" for i in range(60)]
    texts += [" ".join(passage[rng.randrange(8) :] + [f"q{rng.randrange(4000)}" for _ in range(rng.randrange(2, 30))]) for _ in range(40)]
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_near_classes_equal_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard.index_lists, "__defaults__", (3,))  # also the pairs of frequent tokens
    texts = near_texts(seed)
    sets = [frozenset(zip(*[t.split()[i:] for i in range(5)], strict=False)) or frozenset([tuple(t.split())]) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
            a, b = sorted((root(i), root(j)))
            label[b] = a
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_classes(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_components_of_a_long_path(spark):
    pairs = spark.range(200).selectExpr("id AS a", "id + 1 AS b").union(spark.createDataFrame([(900, 901)], "a long, b long"))
    got = dict(components(pairs).collect())
    assert got == {**{i: 0 for i in range(201)}, 900: 900, 901: 900}


def test_one_of_each_keeps_unrelated_texts_of_one_id_or_none(spark):
    rng = random.Random(6)
    text = [" ".join(rng.choices("abcdefghijklmnop", k=40)) for _ in range(7)]
    rows = [
        (None, text[0], "s"), (None, text[1], "s"), (None, text[2], "t"), (5, text[3], "s"), (5, text[4], "s"), (5, text[4], "s"),
        (None, text[5], "s"), (7, text[5], "t"), (8, text[5] + " z", "t"), (None, text[6], "s"), (None, text[6], "s"),
        (None, "", "s"), (None, None, "s"), (9, "", "s"),
    ]
    got = jaccard.one_of_each(spark, docs(spark, rows), "").collect()
    want = [(None, text[0]), (None, text[1]), (None, text[2]), (5, text[3]), (5, text[4]), (7, text[5]), (None, text[6]), (None, ""), (None, None), (9, "")]
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(want)


# ---- repeated spans


def test_repeated_rows_equal_counting():
    rng = random.Random(3)
    base = [bytes(rng.choices(b"abc d", k=rng.randint(200, 700))) for _ in range(12)]
    texts = []
    for _ in range(40):
        t = b""
        for _ in range(rng.randint(1, 4)):
            b, o = rng.choice(base), rng.randint(0, 50)
            t += b[o : o + rng.randint(150, 500)] if rng.random() < 0.6 else bytes(rng.choices(b"xyz ", k=rng.randint(10, 400)))
        texts.append(t)
    texts += [b"a" * 900, b"ab" * 400, texts[3]]
    counts = Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for shards in (1, 2, 5):
        runs, found = shared_spans.repeated_rows(texts, np.ones(len(texts)), shards)
        for row in range(len(found)):
            s = runs.string[row]
            string = texts[s][row - runs.first[s] :][:200]
            assert found[row] == (len(string) == 200 and counts[string] > 1)


def test_common_prefixes_of_the_merge():
    texts = [bytes(random.Random(i % 5).choices(b"ab", k=400 + i)) for i in range(20)]
    runs = shared_spans.Runs(texts, 1)
    rows, common = shared_spans.merged_intervals(runs, 3)
    text = lambda r: texts[runs.string[r]][r - runs.first[runs.string[r]] :]
    for a, b, c in zip(rows[:-1], rows[1:], common[1:], strict=True):
        if runs.block[a] and runs.block[b]:
            assert text(a)[:c] == text(b)[:c]
            assert c == 200 or text(a)[: c + 50] != text(b)[: c + 50] or min(len(text(a)), len(text(b))) < c + 50


def test_hot_anchor_takes_the_same_bytes(spark):
    passage = "".join(random.Random(1).choices("abcdefgh ", k=230))
    rows = [(i, "".join(random.Random(100 + i).choices("klmnop ", k=150)) + passage + f" tail {i} " * 9, "s") for i in range(30)]
    rows.append((99, rows[3][1], "s"))
    plain = shared_spans.without_shared_spans(docs(spark, rows)).orderBy("doc_id").collect()
    hot = shared_spans.without_shared_spans(docs(spark, rows), hot_bytes=1000).orderBy("doc_id").collect()
    assert plain == hot
    assert all(r["n_removed"] >= 230 for r in plain)
    assert plain[-1]["n_removed"] == plain[-1]["n_bytes"]


# ---- decontamination


def test_blocks_of_items_give_the_same_hits(spark):
    rng = random.Random(5)
    words = ["k" + str(i) for i in range(300)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([3, 12, 30])))) for i in range(40)]
    rows = []
    for i in range(60):
        text = rng.choices(words, k=80)
        for _, t in rng.sample(items, 2):
            at = rng.randrange(80)
            text[at:at] = t.split()[: rng.choice([9, 11, 30])]
        rows.append((i, " ".join(text), "s"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter()
    windows = {}
    for i, t in items:
        w = t.split()
        n = min(10, len(w))
        for k in range(len(w) - n + 1):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    expected = {}
    for i, text, _ in rows:
        w, hit, ids = text.split(), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    ids |= windows[tuple(w[k : k + n])]
        expected[i] = (len(hit), sorted(ids))
        want[i] = len(hit)
    for size in (1 << 20, 700):
        out = decontamination.with_hits(docs(spark, rows), bench, "h", block_bytes=size).collect()
        assert {r["doc_id"]: (r["h"]["n_hit"], sorted(r["h"]["items"] or [])) for r in out} == expected
        for r in out:
            assert sum(r["h"]["ends"] or []) - sum(r["h"]["starts"] or []) == r["h"]["n_hit"]


def test_longest_match_and_places():
    ids = np.array([2, 3, 4, 5, 0, 3, 4, 5, 6, 0])
    order = decontamination.suffix_order(ids, np.arange(len(ids)), 6)
    suffix = [tuple(ids[p : p + 6]) for p in order]
    assert suffix == sorted(suffix)
    test = np.array([3, 4, 5, 6, 9])
    longest, first, last = decontamination.search(ids, order, test, np.full(5, 5), np.array([3, 3, 0, 0, 0]))
    assert longest.tolist() == [4, 3, 2, 1, 0]
    assert (last - first).tolist()[:2] == [2, 1]


# ---- sharding and mixing


def plain_jump(key: int, n: int) -> int:
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop(spark):
    keys = [0, 1, 2, -1, -(1 << 62), (1 << 63) - 1, -(1 << 63), *(random.Random(2).randrange(-(1 << 63), 1 << 63) for _ in range(300))]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    for n in (1, 7, 40):
        for k, j in df.select("k", sharding.jump(df["k"], n).alias("j")).collect():
            assert (j["shard"], j["grown"]) == (plain_jump(k, n), plain_jump(k, n + 1))
            assert j["grown"] in (j["shard"], n)


def test_slots_have_no_gap_when_buckets_split(spark):
    rows = spark.createDataFrame([(i % 3, 5 if i % 2 else i, i) for i in range(400)], "g int, k long, at long")
    got = defaultdict(list)
    for r in sharding.slots(rows, "g", "k", [], "at", target=7).collect():
        got[r["g"]].append((r["slot"], r["k"]))
    for found in got.values():
        assert [s for s, _ in sorted(found)] == list(range(len(found)))
        assert [k for _, k in sorted(found)] == sorted(k for _, k in found)


def test_quotas_are_highest_quotients_shard_by_shard(spark):
    targets = {"a": 1000.0, "b": 333.0, "c": 90.5, "d": 0.0, None: 12.0}
    mix = mixing.Mix(block=10, shards=5)
    frame = spark.createDataFrame([(s, t) for s, t in targets.items()], "source string, target double")
    got = defaultdict(dict)
    for r in mixing.block_quotas(frame, mix).collect():
        got[r["shard"]][r["source"]] = r["quota"]
    blocks, names = round(sum(targets.values()) / 10), list(targets)
    before = dict.fromkeys(names, 0)
    for k in range(5):
        seats = dict.fromkeys(names, 0)
        for _ in range(blocks * (k + 1) // 5):
            best = max(names, key=lambda s: targets[s] / (2 * seats[s] + 1))
            seats[best] += 1
        assert got[k] == {s: seats[s] - before[s] for s in names}
        before = seats


def test_stage_takes_each_row_by_its_own_count(spark):
    rng = random.Random(12)
    rows = [(i, "w " * rng.randrange(20, 90), f"s{i % 3}") for i in range(60)]
    rows += [(None, f"no id {i} " * 9, "s0") for i in range(12)] + [(3, "again and again " * 12, "s1")] * 6 + [(4, "other text " * 11, "s2")]
    frame = docs(spark, rows)
    taken = mixing.mixed(mixing.written(mixing.sized(frame), "sizes")).filter("taken > 0").collect()
    want = Counter()
    for r in taken:
        want[r["doc_id"], r["source"], r["size"]] += -(-r["taken"] // r["size"])
    got = mixing.take(spark, frame, "").collect()
    assert Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in got) == want
    times = Counter(r["text"] for r in got)
    assert all(n <= mixing.Mix().epochs * rows.count(next(x for x in rows if x[1] == text)) for text, n in times.items() if text.startswith(("no", "again", "other")))


# ---- lines


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i * 100 + s, f"line of {i} sites", f"site{s}") for i in range(5, 16) for s in range(i)]
    out = line_spread.without_boilerplate(docs(spark, rows)).collect()
    assert {r["doc_id"] // 100: r["n_removed"] for r in out} == {i: int(i >= 10) for i in range(5, 16)}


# ---- licenses


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:"""


def test_notices_are_found_over_line_breaks_and_not_in_scattered_words(spark):
    far = " filler words that say nothing at all"
    scattered = "released" + far + " under" + far + " the" + far + " mit" + far + " license"
    rows = [
        (1, MIT), (2, BSD.replace("\n", "\n * ")), (3, MIT.replace("\n", " ")), (4, "x " * 5000 + MIT + " y" * 5000), (5, scattered), (6, scattered * 200),
        (7, "Released under\nthe MIT\nLicense"), (8, "released under some mit license"), (9, "released under under mit license license"),
        (10, "released a b mit license"), (11, " ".join(MIT.split()[:12])), (12, BSD + "\n\n" + MIT), (13, None),
    ]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.with_licenses(docs(spark, rows, "doc_id long, text string")).collect()}
    found = {1: "mit-notice", 2: "bsd-notice", 3: "mit-notice", 4: "mit-notice", 7: "mit", 8: "mit", 9: "mit", 12: "bsd-notice,mit-notice"}
    assert {i: labels for i, (labels, _) in got.items() if labels} == found
    assert got[1][1] == got[12][1] == 1.0 and got[8][1] == 0.8 and got[5][1] == 0.0


def plain_windows(text: str, percent: int = 80) -> dict[str, float]:
    words, out = text.split(), {}
    for label, t in licenses.TEMPLATES.items():
        own, n = set(t.split()), len(t.split()) * 100 // percent
        share = max((len(own & set(words[i : i + n])) for i in range(len(words))), default=0)
        if share * 100 >= len(own) * percent:
            out[label] = share / len(own)
    return out


def test_windows_equal_a_plain_search(spark):
    rng, rows = random.Random(8), []
    for i in range(120):
        text = []
        for _ in range(rng.randrange(1, 5)):
            text += rng.choices(["the", "of", "x", "license", "under"], k=rng.randrange(0, 12))
            words = [w for w in rng.choice(list(licenses.TEMPLATES.values())).split() if rng.random() < 0.93]
            for _ in range(rng.randrange(0, 6)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["x", "the"]))
            text += words
        rows.append((i, " ".join(text)))
    for r in licenses.with_licenses(docs(spark, rows, "doc_id long, text string")).collect():
        want = plain_windows(rows[r["doc_id"]][1])
        base = set(r["base_labels"].split(",")) - {""}
        assert set(r["labels"].split(",")) - {""} == base | set(want)
        assert base or r["score"] == max(want.values(), default=0.0)


# ---- scores


def test_scores_equal_a_plain_computation(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["the", "The", "a", "cat", "dog", "runs", f"w{rng.randrange(40)}"], k=rng.randrange(0, 30))), "s") for i in range(300)]
    rows.append((301, None, "s"))
    frame = docs(spark, rows)
    got = {r["doc_id"]: r for r in interpolation.scored(frame).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 10 for i, _, _ in rows}
    tokens = {i: [*(t or "").lower().split(), None] for i, t, _ in rows}
    words, pairs, contexts = Counter(), Counter(), Counter()
    for i, t in tokens.items():
        if fold[i]:
            words.update(t)
            pairs.update(zip(["<", *t], t, strict=False))
            contexts.update(["<", *t[:-1]])
    n, v = sum(words.values()), len(words)
    from pyspark.sql import functions as F

    model = interpolation.fitted(frame.select(F.col("doc_id").alias("at"), F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)).cast("int").alias("fold"), "text"))
    assert np.allclose(model.weights.sum(1), 1)
    for i, t in tokens.items():
        base = sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        score = 0.0
        for before, x in zip(["<", *t], t, strict=False):
            seen = contexts[before]
            w = model.weights[int(math.log2(seen)) + 1 if seen else 0]
            score += math.log10(w[0] * pairs[before, x] / max(1, seen) + w[1] * words[x] / n + w[2] / (v + 1))
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold[i] == 0, len(t), sum(words[x] > 0 for x in t), n)
        assert r["base_score"] == pytest.approx(base, abs=1e-9) and r["score"] == pytest.approx(score, abs=1e-9)


def test_held_out_texts_are_likelier_than_by_words_alone(spark):
    out = interpolation.scored(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").selectExpr("sum(base_score) b", "sum(score) s").first()
    assert out["s"] > out["b"]


def test_weights_never_lower_the_likelihood():
    table = pd.DataFrame({"bucket": [1, 1, 2, 2], "pair": [-8.0, None, -4.0, None], "word": [-30.0, -40.0, -50.0, None], "n": [50, 30, 70, 5]})

    def likelihood(w):
        p = np.stack([np.where(table["pair"].isna(), 0, 2 ** (table["pair"].fillna(0) / 8)), np.where(table["word"].isna(), 0, 2 ** (table["word"].fillna(0) / 8)), np.full(4, 0.001)], 1)
        return (table["n"] * np.log((w[table["bucket"]] * p).sum(1))).sum()

    assert likelihood(interpolation.learned(table, 0.001)) > likelihood(np.full((64, 3), 1 / 3))


# ---- transcripts


def test_viterbi_is_the_best_of_all_sequences():
    rng = np.random.default_rng(4)
    n = len(transcripts.STATES)
    model = transcripts.Model(*(np.log(x / x.sum(-1, keepdims=True)) for x in (rng.random(n), rng.random((n, n)), rng.random((n, transcripts.SEEN)))))
    for _ in range(5):
        seen = rng.integers(0, transcripts.SEEN, 5).tolist()

        def value(s):
            return model.start[s[0]] + sum(model.move[a, b] for a, b in itertools.pairwise(s)) + sum(model.emit[a, x] for a, x in zip(s, seen, strict=True))

        best = max(itertools.product(range(n), repeat=5), key=value)
        assert transcripts.viterbi(model, seen) == list(best)


def test_roles_are_recovered_and_rendered(spark):
    out = transcripts.op1_transcripts(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(n_right) / sum(n_lines) AS share").first()
    assert out["share"] > 0.9
    made = transcripts.raw_transcripts(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))
    model = transcripts.fitted(made)
    roles, found = transcripts.turns("User: Hi there\nmore\nAssistant: Note: fine\n\nUser: bye", model)
    assert roles == ["user", "user", "assistant", "user"]
    assert transcripts.rendered(found[:1]) == "<|user|>\nHi there\nmore\n<|end|>\n"
    assert found[1] == ("assistant", "Note: fine")
    assert transcripts.turns(" \n\n", model) == ([], [])


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_markers_of_short_lines_are_read(spark, sf):
    model = transcripts.fitted(transcripts.raw_transcripts(spark.read.parquet(f"/root/testdata/sf{sf}/conversations.parquet")))
    for system, user, assistant in transcripts.STYLES:
        for size in range(1, 9):
            said = [(system, "system"), (user, "user"), (assistant, "assistant"), (user, "user"), (assistant, "assistant")]
            said = said if assistant else said[:2]
            text = "\n".join(m + "abcdefgh"[:size] for m, _ in said)
            assert transcripts.turns(text, model)[0] == [role for _, role in said], text


def test_blank_lines_are_the_same_in_sql_and_python(spark):
    said = [
        (1, 0, "user", "Hello?\r\n\r\nmore\r"), (1, 1, "assistant", "Yes.\n\t\n\u00a0\nno"), (2, 0, "user", "\u00a0"), (2, 1, "user", "\x0b\n \u3000 \nx"),
        (3, 0, "user", "\r\n\t"),
    ]
    made = transcripts.raw_transcripts(spark.createDataFrame(said, "conv_id long, turn long, role string, text string"))
    for r in made.collect():
        assert len(transcripts.observed(r["text"].split("\n"))) == len(r["states"])
    got = {r["conv_id"]: r["n_lines"] for r in transcripts.parsed(made, transcripts.fitted(made)).collect()}
    assert got == {1: 4, 2: 1}
    assert sorted(transcripts.BLANKS) == [chr(i) for i in range(0x110000) if chr(i).isspace()]


# ---- collocations ---------------------------------------------------------------------------------------------------


def test_quicksort_counts_every_frequent_phrase():
    rng = np.random.default_rng(5)
    for n, words, whole in ((0, 3, 2), (1, 3, 2), (3000, 4, 2), (3000, 4, 3), (5000, 60, 2), (5000, 60, 3), (2000, 1, 3)):
        keys = rng.integers(1, words + 1, (n, 3)).astype(np.uint64)
        keys[rng.random(n) < 0.2, 2] = 0
        keys[: n // 3, :2] = 1  # a hot beginning
        weights = rng.integers(1, 4, n)
        counts = Counter()
        for row, weight in zip(keys.tolist(), weights.tolist(), strict=True):
            for m in (2, 3):
                if row[m - 1]:
                    counts[tuple(row[:m])] += weight
        row, size, weight = collocations.quicksorted(keys, weights, 10, whole)
        got = {tuple(keys[r, :m].tolist()): int(x) for r, m, x in zip(row, size, weight, strict=True)}
        assert len(got) == len(row)
        assert got == {k: c for k, c in counts.items() if c >= 10 or len(k) < whole}


def test_frames_keep_every_suffix():
    rng = np.random.default_rng(6)
    keys = rng.integers(1, 9, (4000, 3)).astype(np.uint64)
    weights = rng.integers(1, 4, 4000)
    held = list(collocations.frames(keys, weights, 2, 7, 1))
    table = pa.table({c: [r[i] for r in held] for i, c in enumerate(("bucket", "n", "names", "places", "weights"))})
    got_keys, got_weights = collocations.unframed(table, 3)
    want = Counter()
    for k, w in zip(keys.tolist(), weights.tolist(), strict=True):
        want[tuple(k)] += w
    got = Counter()
    for k, w in zip(got_keys.tolist(), got_weights.tolist(), strict=True):
        got[tuple(k)] += w
    assert got == want


def plain_collocations(rows, mine):
    out = []
    for lang in {r[0] for r in rows}:
        f = Counter()
        for language, text in rows:
            if language == lang:
                for piece in text.split("."):
                    words = piece.split()
                    for m in range(1, mine.longest + 1):
                        f.update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
        n = sum(c for k, c in f.items() if len(k) == 1)
        cand = {k: c for k, c in f.items() if len(k) > 1 and c >= mine.least}
        scored = []
        for k, a in cand.items():
            inside = any(len(o) > len(k) and any(o[i : i + len(k)] == k for i in range(len(o))) and 100 * b >= mine.inside * a for o, b in cand.items())
            if not inside:
                s, c = min((1000000 * a * a // (f[k[:c]] * f[k[c:]]), c) for c in range(1, len(k)))
                scored.append((-s, -a, " ".join(k), f[k[:c]], f[k[c:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[: mine.top], 1):
            out.append((lang, rank, phrase, -a, left, right, n, -s))
    return sorted(out)


@pytest.mark.parametrize("longest, bucket", [(3, 1 << 19), (3, 64), (4, 64), (2, 64)])
def test_collocations_equal_a_plain_count(spark, monkeypatch, longest, bucket):
    """With small buckets, which are dealt again, by two words and then by all: a third of all pairs is one pair."""
    monkeypatch.setattr(collocations, "BUCKET", bucket)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(40)]
        for j in range(0, 36, 3):
            words[j : j + 2] = ["very", "common"]
        rows.append((("aa", "bb", "cc")[i % 3], " ".join(words[:20]) + ". " + " ".join(words[20:])))
    mine = collocations.Mine(longest=longest, least=5, inside=60, top=150)
    frame = spark.createDataFrame(rows, "lang string, text string")
    got = collocations.collocations(frame, mine).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == plain_collocations(rows, mine)


# ---- hard negatives -------------------------------------------------------------------------------------------------


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2), (1, 5)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        place = hard_negatives.hilbert(points, bits)
        assert sorted(place.tolist()) == list(range(len(points)))
        assert (np.abs(np.diff(points[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_all_products():
    rng = np.random.default_rng(3)
    for scale in (300, 1 << 25):
        x, rows = rng.integers(-scale, scale, (20, 9)), rng.integers(-scale, scale, (50, 9))
        low, high = hard_negatives.bounds(x, rows.min(0)[None], rows.max(0)[None])
        exact = np.array([[sum(int(a) * int(b) for a, b in zip(p, q, strict=True)) for q in rows] for p in x])
        assert (hard_negatives.product(x, rows.T) == exact).all()
        assert (low <= exact).all() and (exact <= high).all()


def test_hard_negatives_equal_a_plain_search(spark, monkeypatch):
    """Small blocks and parts, clusters that zones tell apart, copies of one vector for a third of the rows."""
    for name, value in (("BLOCK", 16), ("READ", 3), ("ZONES", 4)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(2)
    rows = []
    for i in range(360):
        centre = [40, 0, 0, 0] if i % 3 == 0 else [rng.choice([-60, 60]), rng.choice([-60, 60]), 10, 0]
        spread = 0 if i % 3 == 0 else 20
        rows.append((i, rng.randrange(3), [c + rng.randint(-spread, spread) for c in centre]))
    mining = hard_negatives.Mining(positives=3, negatives=4, low=20, high=95)
    frame = spark.createDataFrame(rows, "vec_id long, label long, vector array<long>")
    got = sorted(map(tuple, hard_negatives.hard_negatives(frame, frame["vec_id"] % 9 == 0, mining).collect()))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    want = []
    for i, label, v in rows[::9]:
        scored = sorted((-dot(v, w), j, k) for j, k, w in rows if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:3]:
            found = [s for s in scored if s[2] != label and 20 * -p <= 100 * -s[0] <= 95 * -p][:4]
            want += [(i, j, r, n, -p, -s) for r, (s, n, _) in enumerate(found, 1)]
    assert got == sorted(want) and len(got) > 100


# ---- personal data --------------------------------------------------------------------------------------------------


def test_checksums_and_masks(spark):
    from tallyframe.llm import personal_data as PD

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def mod97(a):
        return int("".join(str(int(c, 36)) for c in a[4:] + a[:4])) % 97 == 1

    rng = random.Random(1)
    numbers = ["".join(rng.choice("0123456789") for _ in range(rng.randrange(1, 20))) for _ in range(300)]
    accounts = ["GB82WEST12345698765432", "DE89370400440532013000"] + ["".join(rng.choice("GBDE0123456789") for _ in range(22)) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in numbers], "x string").select("x", PD.luhn(F.col("x")).alias("ok"))
    assert {r["x"]: r["ok"] for r in df.collect()} == {x: luhn(x) for x in numbers}
    df = spark.createDataFrame([(x,) for x in accounts], "x string").select("x", PD.mod97(F.col("x")).alias("ok"))
    assert {r["x"]: r["ok"] for r in df.collect()} == {x: mod97(x) for x in accounts}
    texts = [("to a@b.cd or +1 (958) 555-1150!", "to [EMAIL] or [PHONE]!"), ("é 4111 1111 1111 1111", "é [CARD]"), ("none", "none"), ("", ""), (None, None)]
    df = PD.with_spans(spark.createDataFrame([(t,) for t, _ in texts], "text string"))
    got = {r["text"]: r["m"] for r in df.select("text", PD.masked(F.col("text"), F.col("spans")).alias("m")).collect()}
    assert got == dict(texts)


def test_blocks_named_by_part_of_a_hash_stay_apart():
    rnd = np.random.default_rng(4)
    low = rnd.integers(0, 2**40, 3000, dtype=np.uint64)
    hashes = np.concatenate([low, low[:50] | np.uint64(1 << 63), low[:20]])  # 50 differ in the highest bit alone, 20 repeat
    names = shared_spans.named(hashes)
    assert len(set(names.tolist())) == len(set(hashes.tolist())) == len(set(zip(names.tolist(), hashes.tolist(), strict=True)))
    for keys in (rnd.integers(0, 9, 3000), hashes):
        assert (shared_spans.stable_order(keys) == np.argsort(keys, kind="stable")).all()
