"""Programme texts: paragraphs, batches, quotations, readability, shared text and promise counts.

Work inside one text (lines, word runs, paragraph breaks) is done in the row that holds the text; only what compares
texts is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tallyframe.functions import text as X
from tallyframe.operators.temporal import newest
from tallyframe.params import DEFAULT, Params
from tallyframe.storage import written

# ---- paragraphs -----------------------------------------------------------------------------------------------------

# What opens a list item, ends a sentence, and rules a short line out as a heading.
BULLET = r"^\s*(?:[•●▪■◦\-–—*o]\s+|\d{1,2}[.)]\s+|[a-z][.)]\s+)"
SENTENCE_END = r"[.!?:;]\s*$"
NOT_HEADING = r"[,.;:!?\-]\s*$"

_BREAK, _GLUE = "\u0001", "\u0002"


def _starts_lower(text: Column) -> Column:
    return F.trim(text).rlike(r"^\p{Ll}")


def _starts_upper(text: Column) -> Column:
    return F.trim(text).rlike(r"^\p{Lu}")


def paragraph_texts(text: Column) -> Column:
    """Paragraphs of a page, as an array.

    Lines are joined; a new paragraph starts after a blank line, at a list item, after a short line that ends a sentence,
    and after a heading (short, no final punctuation) followed by a capital. A word hyphenated at a line end is rejoined.
    A line's width is measured against the upper quartile of the page's lines. Everything a break depends on lies in a
    line and the one before it, so the page is one array expression: no shuffle.
    """
    lines = F.transform(
        F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"),
        lambda r, i: F.struct(i.alias("at"), F.regexp_replace(r, r"\s+$", "").alias("line")),
    )

    def join(full: Column, wide: Column) -> Column:
        def piece(e: Column, i: Column) -> Column:
            before = F.get(full, i - 1)
            prev, line = before["line"], e["line"]
            width = F.length(prev)
            closed = (e["at"] > before["at"] + 1) | ((width * 100 < 85 * wide) & prev.rlike(SENTENCE_END))
            heading = (width * 10 < 7 * wide) & ~prev.rlike(NOT_HEADING)
            new = closed | line.rlike(BULLET) | (heading & _starts_upper(line))
            hyphen = prev.endswith("-") & ~prev.endswith(" -") & _starts_lower(line)
            glue = F.when(i == 0, "").when(new, _BREAK).when(hyphen, _GLUE).otherwise(" ")
            return F.concat(glue, F.trim(line))

        return F.array_join(F.transform(full, piece), "")

    def width(full: Column) -> Column:
        widths = F.array_sort(F.transform(full, lambda e: F.length(e["line"])))
        return F.get(widths, F.floor(F.size(full) * 3 / 4).cast("int"))

    filled = F.filter(lines, lambda e: F.trim(e["line"]) != "")
    joined = X.let(filled, lambda full: X.let(width(full), lambda wide: join(full, wide)))
    texts = F.split(F.replace(joined, F.lit("-" + _GLUE), F.lit("")), _BREAK)
    clean = F.transform(texts, lambda t: F.trim(F.regexp_replace(t, r"\s+", " ")))
    return F.filter(clean, lambda t: F.length(t) > 1)


def page_paragraphs(pages: DataFrame) -> DataFrame:
    """(document_id, page, n, text, reread) from (document_id, page, text, reread); n counts within the page."""
    exploded = pages.select("document_id", "page", "reread", F.posexplode(paragraph_texts(F.col("text"))).alias("n", "text"))
    return exploded.select("document_id", "page", "n", "text", "reread")


# Words of one or two letters that may open a paragraph.
SHORT_WORDS = (
    "a e è i o il lo la le li un in di da su ne né ci vi si se ma no ed ad al ai tu io sì ue pa"
).split()
MISREAD_SIGN = r"^([A-ZÀ-Ý]\p{L}?)\s+(?=\S)"


def without_reading_noise(paragraphs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Cleans paragraphs of reread pages; the others pass untouched.

    A misread sign at the start is stripped unless it is a short word. A paragraph is dropped when fewer than three
    letters remain, or when none of its words of three letters or more is in the dictionary.
    """
    sign = F.lower(F.regexp_extract("text", MISREAD_SIGN, 1))
    stripped = F.when((sign != "") & ~sign.isin(*SHORT_WORDS), F.regexp_replace("text", MISREAD_SIGN, "")).otherwise(
        F.col("text")
    )
    reread = paragraphs.filter("reread").withColumn("text", stripped).filter(
        F.length(F.regexp_replace("text", r"[^\p{L}]", "")) >= 3
    )
    found = measured(reread, spoken_words(F.col("text")), dictionary, 1)
    if found is not None:
        return paragraphs.filter("NOT reread").unionByName(found.filter("known > 0").select(*paragraphs.columns))
    keys = ["document_id", "page", "n"]
    spoken = F.array_distinct(spoken_words(F.col("text")))
    words_ = reread.select(*keys, F.explode(spoken).alias("word"))
    known = words_.join(dictionary.select("word"), "word", "left_semi").select(*keys).distinct()
    return paragraphs.filter("NOT reread").unionByName(reread.join(known, keys, "left_semi"))


def document_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """(document_id, n, page, text, reread): a paragraph that runs on to the next page is put back together.

    The first paragraph of a page continues the one before when it starts in lower case and that one does not end a
    sentence. `page` is where the paragraph starts.
    """
    order = Window.partitionBy("document_id").orderBy("page", "n")
    on_page = Window.partitionBy("document_id", "page").orderBy("n")
    before = F.lag("text").over(order)
    runs_on = (
        before.isNotNull() & (F.row_number().over(on_page) == 1)
        & F.col("text").rlike(r"^\p{Ll}") & ~before.rlike(SENTENCE_END)
    )
    numbered = paragraphs.withColumn("_new", (~runs_on).cast("int")).withColumn("_k", F.sum("_new").over(order))
    pieces = F.array_sort(F.collect_list(F.struct("page", "n", "text")))
    return numbered.groupBy("document_id", "_k").agg(
        F.array_join(F.transform(pieces, lambda e: e["text"]), " ").alias("text"), F.min("page").alias("page"),
        F.bool_or("reread").alias("reread"),
    ).select("document_id", F.col("_k").cast("int").alias("n"), "page", "text", "reread")


def _pack(limit: int):
    @F.pandas_udf(ArrayType(IntegerType()))
    def pack(sizes: pd.Series) -> pd.Series:
        def one(values):
            out, batch, used = [], 0, 0
            for size in values:
                if out and batch == out[-1] and used + size > limit:
                    batch, used = batch + 1, 0
                out.append(batch)
                used += int(size)
            return out

        return sizes.map(one)

    return pack


def greedy_batches(paragraphs: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Adds `batch`: consecutive paragraphs of a document up to the limit of characters; an oversize one stands alone.

    Filling is sequential within a document, so only the lengths (one small array per document) go through Python.
    """
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("n", F.length("text").alias("size")))), lambda e: e["size"])
    order = F.transform(F.array_sort(F.collect_list(F.struct("n"))), lambda e: e["n"])
    per_document = paragraphs.groupBy("document_id").agg(sizes.alias("_sizes"), order.alias("_order"))
    packed = per_document.withColumn("_batch", _pack(p.batch_chars)("_sizes"))
    return packed.select(
        "document_id", F.explode(F.arrays_zip(F.col("_order").alias("n"), F.col("_batch").alias("batch"))).alias("_e")
    ).select("document_id", "_e.n", "_e.batch")


def fixed_batches(items: DataFrame, key: str, order: list[Column], size: int) -> DataFrame:
    """Adds `batch`: runs of `size` items within each key, in order.

    Items are numbered within each value of the first order column and shifted by the counts of the values before, so a
    task sorts the items of one value, and a key's values only as one row each.
    """
    first, *rest = order
    marked = items.withColumn("_first", first)
    counts = marked.groupBy(key, "_first").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(F.struct(key, "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")).alias("_s"))
    own = Window.partitionBy(key, "_first").orderBy(*(rest or [first]))
    placed = marked.withColumn("_place", F.row_number().over(own) - 1).join(
        shifts, F.col(key).eqNullSafe(F.col(f"_s.{key}")) & F.col("_first").eqNullSafe(F.col("_s._first"))
    )
    batch = F.floor((F.col("_place") + F.col("_s._before")) / size).cast("int")
    return placed.withColumn("batch", batch).drop("_place", "_first", "_s")


def batch_inputs(items: DataFrame, keys: list[str], template: str) -> DataFrame:
    """(keys, input, input_sha): the numbered items of a batch in the template, and the hash that identifies them."""
    entry = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), F.col("text"))
    lines = F.array_sort(F.collect_list(F.struct("n", entry.alias("line"))))
    body = F.array_join(F.transform(lines, lambda e: e["line"]), "\n")
    made = items.groupBy(*keys).agg(F.replace(F.lit(template), F.lit("{items}"), body).alias("input"))
    return made.withColumn("input_sha", F.sha2("input", 256))


# ---- quotations -----------------------------------------------------------------------------------------------------


QUOTES_A_PASS = 2000  # quotations searched for together


def first_places(whole: str, quotes: list[str]) -> list[int]:
    """Where each quotation first stands in the text, counted from 1, or 0: one pass over the text for all of them."""
    automaton = ahocorasick.Automaton()
    for i, quote in enumerate(quotes):
        automaton.add_word(quote, i)
    places, left = [0] * len(quotes), len(quotes)
    if left:
        automaton.make_automaton()
        for end, i in automaton.iter(whole):
            if not places[i]:
                places[i], left = end - len(quotes[i]) + 2, left - 1
                if not left:
                    break
    return places


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, quotes = batch.column("_whole").to_pylist(), batch.column("_quotes").to_pylist()
        places = pa.array([first_places(t, q) for t, q in zip(texts, quotes, strict=True)], pa.list_(pa.int32()))
        names = [c for c in batch.schema.names if c != "_whole"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], places], [*names, "_places"])


def verify_quotes(claims: DataFrame, paragraphs: DataFrame, p: Params = DEFAULT, keys: tuple[str, ...] = ("document_id",)) -> DataFrame:
    """Adds (outcome, para_from, para_to) to claims (document_id, ord, quote, measure).

    Outcome: 'kept'; 'measure_empty'; 'quote_not_found' (too short, or not verbatim in the document on the normal form);
    'repeated' for the same quote and measure again. A quotation may run over several paragraphs. `keys` name what is searched
    as one text, in claims and paragraphs: a document, or a batch of it.

    A document meets the different quotations asked of it once (once per QUOTES_A_PASS of them) and is searched in one pass;
    what moves on is where they stand.
    """
    keys = list(keys)
    sorted_paras = F.array_sort(F.collect_list(F.struct("n", F.col("_t").alias("text"))))
    documents = (
        paragraphs.withColumn("_t", X.nfkc(F.col("text"))).groupBy(*keys).agg(sorted_paras.alias("_paras"))
        .withColumn("_pieces", _folded_pieces(F.col("_paras")))
        .select(
            *keys, F.transform("_pieces", lambda e: e["n"]).alias("_ns"), _piece_starts(F.col("_pieces")).alias("_starts"),
            F.array_join(F.transform("_pieces", lambda e: F.concat(e["gap"], e["text"])), "").alias("_whole"),
        )
    )
    measure = F.trim(F.coalesce("measure", F.lit("")))
    asked = claims.withColumn("_quote", X.quote_form(X.bare_quote(F.col("quote")))).withColumn("_measure", X.quote_form(measure))
    asked = written(asked, "asked")
    wanted = asked.filter((F.length("_quote") >= p.min_quote) & (F.col("_measure") != "")).select(*keys, "_quote").distinct()
    passes = wanted.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / QUOTES_A_PASS).alias("_passes"))
    grouped = wanted.join(passes, keys).groupBy(*keys, F.pmod(F.xxhash64("_quote"), F.col("_passes")).alias("_pass")).agg(F.collect_list("_quote").alias("_quotes"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in claims.select(*keys).dtypes)
    n = dict(paragraphs.dtypes)["n"]
    searched = documents.join(grouped.drop("_pass"), keys).select(*keys, "_ns", "_starts", "_quotes", "_whole").mapInArrow(
        _searched, f"{kinds}, _ns array<{n}>, _starts array<int>, _quotes array<string>, _places array<int>"
    )
    found = searched.select(*keys, "_ns", "_starts", F.explode(F.arrays_zip("_quotes", "_places")).alias("_f")).filter("_f._places > 0")
    begin = F.col("_f._places") - 1
    end = begin + F.length("_f._quotes")
    places = found.select(
        *keys, F.col("_f._quotes").alias("_quote"), F.lit(True).alias("_stands"),
        F.get("_ns", F.size(F.filter("_starts", lambda s: s <= begin)) - 1).alias("para_from"),
        F.get("_ns", F.size(F.filter("_starts", lambda s: s < end)) - 1).alias("para_to"),
    )
    judged = asked.join(places, [*keys, "_quote"], "left").withColumn("_found", F.coalesce("_stands", F.lit(False)) & (F.col("_measure") != ""))
    again = F.row_number().over(Window.partitionBy(*keys, "_found", "_quote", "_measure").orderBy("ord"))
    outcome = (
        F.when(F.col("_measure") == "", "measure_empty").when(~F.col("_found"), "quote_not_found")
        .when(again > 1, "repeated").otherwise("kept")
    )
    kept = F.col("outcome") == "kept"
    return judged.withColumn("outcome", outcome).select(
        *claims.columns, "outcome", *[F.when(kept, F.col(c)).alias(c) for c in ("para_from", "para_to")]
    )


def _folded_pieces(paras: Column) -> Column:
    """Folded paragraphs (n, text, gap) that concatenate to the folded document; empty ones are left out.

    Folding a joined text equals joining folded texts, except for the space between two of them: it goes when the first
    ends with a dash or an opening bracket, or the second starts with a dash or closing punctuation.
    """
    folded = F.transform(paras, lambda e: F.struct(e["n"].alias("n"), X.folded(e["text"]).alias("text")))

    def spaced(ps: Column) -> Column:
        def one(e: Column, i: Column) -> Column:
            tight = F.get(ps, i - 1)["text"].rlike(r"[-(\[]$") | e["text"].rlike(r"^[-,.;:!?)\]]")
            gap = F.when((i == 0) | tight, "").otherwise(" ")
            return F.struct(e["n"].alias("n"), e["text"].alias("text"), gap.alias("gap"))

        return F.transform(ps, one)

    return X.let(F.filter(folded, lambda e: e["text"] != ""), spaced)


def _piece_starts(pieces: Column) -> Column:
    """Length of the folded document before each piece."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("starts"))

    def add(done: Column, e: Column) -> Column:
        total = done["total"] + F.length(e["gap"]) + F.length(e["text"])
        return F.struct(total.alias("total"), F.array_append(done["starts"], done["total"]).alias("starts"))

    return F.aggregate(pieces, start, add, lambda done: done["starts"])


# ---- dictionary and readability -------------------------------------------------------------------------------------


LONG_WORD = r"(\p{L}{3,})"


def document_words(documents: DataFrame, key: str) -> DataFrame:
    """(key, pos, word): words of three letters or more in order, lower case without accents.

    Letters are folded once per text, not once per word. Runs of letters are maximal, so a pattern of three letters or
    more finds exactly the words that are long enough.
    """
    return documents.select(key, F.posexplode(spoken_words(F.col("text"))).alias("pos", "word"))


def dictionary_of(documents: DataFrame, min_documents: int) -> DataFrame:
    """Words found in at least `min_documents` texts.

    A text's words are made distinct inside its row, so the only shuffle carries one partial count per word and task.
    """
    spoken = F.array_distinct(spoken_words(F.col("text")))
    counts = documents.select(F.explode(spoken).alias("word")).groupBy("word").agg(F.count("*").alias("_n"))
    return counts.filter(F.col("_n") >= min_documents).select("word")


def readability(words_: DataFrame, key: str, dictionary: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(key, words, worst, readable): known words in the worst run of consecutive words.

    A text shorter than the window is measured whole. The worst part decides, not the mean.
    """
    num, den = p.readable_known
    size = p.readable_window
    flagged = words_.join(dictionary.withColumn("_known", F.lit(1)), "word", "left").withColumn(
        "_known", F.coalesce("_known", F.lit(0))
    )
    run = Window.partitionBy(key).orderBy("pos").rowsBetween(-(size - 1), 0)
    sliding = flagged.withColumn("_sum", F.sum("_known").over(run))
    per_text = sliding.groupBy(key).agg(
        F.count("*").alias("words"), F.sum("_known").alias("_all"),
        F.min(F.when(F.col("pos") >= size - 1, F.col("_sum"))).alias("_worst"),
    )
    length = F.least(F.col("words"), F.lit(size))
    worst = F.coalesce("_worst", "_all")
    return per_text.select(key, "words", worst.alias("worst"), (den * worst >= num * length).alias("readable"))


KNOWN_WORDS = 4_000_000  # words of a dictionary that is sent to all tasks, eight bytes each; a larger one is joined


def spoken_words(text: Column) -> Column:
    """The words of three letters or more of a text, in order, lower case without accents."""
    return F.regexp_extract_all(X.base_letters(text), F.lit(LONG_WORD), F.lit(1))


WORDS_AT_ONCE = 200_000  # words whose sums a task holds at a time; a longer text is taken alone


def _pieces(batch: pa.RecordBatch, words_: str) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most WORDS_AT_ONCE words, or of one row."""
    ends, at = batch.column(words_).offsets.to_numpy(), 0
    while at < batch.num_rows:
        last = max(int(np.searchsorted(ends, ends[at] + WORDS_AT_ONCE, "right")) - 1, at + 1)
        yield batch.slice(at, last - at)
        at = last


def _measured(known: np.ndarray, size: int, words_: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole, words_)):
            column = batch.column(words_)
            ends = column.offsets.to_numpy().astype(np.int64)
            ends -= ends[0]
            hashes = column.flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            sums = np.append(0, np.cumsum(known[at] == hashes)) if len(known) else np.zeros(len(hashes) + 1, np.int64)
            count = np.diff(ends)
            total = sums[ends[1:]] - sums[ends[:-1]]
            # known words in the run of `size` words that starts at each word, and the least of a text's whole runs
            worst = total.copy()
            long_ = np.flatnonzero(count >= size)
            if len(long_):
                starts = ends[:-1][long_]
                runs = count[long_] - size + 1
                first = np.cumsum(runs) - runs
                place = np.repeat(starts - first, runs) + np.arange(int(runs.sum()))
                worst[long_] = np.minimum.reduceat(sums[place + size] - sums[place], first)
            names = [c for c in batch.schema.names if c != words_]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(count), pa.array(total.astype(np.int64)), pa.array(worst.astype(np.int64))], [*names, "words", "known", "worst"]
            )

    return run


def measured(texts: DataFrame, words_: Column, dictionary: DataFrame, size: int, keep: list[str] | None = None) -> DataFrame | None:
    """The rows (of them the columns `keep`, if given) with `words`, how many of the words are `known`, and the least number known
    in `size` words on end (in all, if there are fewer): worked out inside the row, so no word becomes a row. None when the
    dictionary, of which one word more than may be sent is asked for, is too large for all tasks."""
    found = dictionary.select(F.xxhash64("word").alias("w")).limit(KNOWN_WORDS + 1).toArrow().column("w")
    if len(found) > KNOWN_WORDS:
        return None
    known = np.sort(found.to_numpy())
    hashed = texts.select(*keep or texts.columns, F.transform(words_, lambda w: F.xxhash64(w)).alias("_hashes"))
    kinds = ", ".join(f"`{c}` {t}" for c, t in hashed.dtypes if c != "_hashes")
    return hashed.mapInArrow(_measured(known, size, "_hashes"), f"{kinds}, words long, known long, worst long")


def readable_texts(texts: DataFrame, key: str, dictionary: DataFrame, p: Params = DEFAULT, text: str = "text") -> DataFrame:
    """`readability` of whole texts; those without a word of three letters are left out."""
    rows = measured(texts.select(key, text), spoken_words(F.col(text)), dictionary, p.readable_window, [key])
    if rows is None:
        return readability(document_words(texts, key), key, dictionary, p)
    num, den = p.readable_known
    length = F.least(F.col("words"), F.lit(p.readable_window))
    return rows.filter("words > 0").select(key, "words", "worst", (den * F.col("worst") >= num * length).alias("readable"))


# ---- shared text ----------------------------------------------------------------------------------------------------


def content_groups(documents: DataFrame) -> DataFrame:
    """(document_id, party_id, sha256, copies, parties): exact copies, as one row per document with the group's size.

    The group's parties are a short registry list; the documents of a group are never listed against each other.
    """
    hashed = documents.select("document_id", "party_id", X.fingerprint(F.col("text")).alias("sha256"))
    sizes = hashed.groupBy("sha256").agg(
        F.count("*").alias("copies"), F.array_sort(F.collect_set("party_id")).alias("parties")
    )
    return hashed.join(sizes, "sha256")


def shared_text(documents: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(document_id, party_id, partner): other parties with a different text that shares more than half of the shorter.

    Share = common runs of six words / runs of the shorter text. Without comparing all pairs; runs and contents are numbers of
    64 bits, made once:

    1. Copies collapse to one content, so a group of copies is compared once.
    2. Runs are ordered from rare to common. If more than half of the shorter text A is in B, then at least one of the
       rarest half of A's runs is in B. Only that half of A looks for partners.
    3. Every (run, party) offers one representative content, so a content meets at most one candidate per run and party
       however many near-copies exist: first the longest, then, where a (content, party) is still open, the shortest.
       Most true pairs are settled here.
    4. What is open after that goes through all contents that hold one of the rare runs, where there is more than the
       representative. Nothing is capped: the passes before only remove work that is already decided.
    """
    hashed = documents.select("document_id", "party_id", "text", F.xxhash64(X.fingerprint(F.col("text"))).alias("content"))
    holders = hashed.select("content", "party_id").distinct()
    # Texts stay where they are read: a copy is told by the first row of its content, which only contents with copies have.
    row = F.struct("document_id", "party_id")
    copied = hashed.groupBy("content").agg(F.min(row).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    contents = hashed.join(written(copied, "copied"), "content", "left").filter(F.col("_first").isNull() | F.col("_first").eqNullSafe(row))
    grams = written(_rare_first(contents.select("content", X.shingle_hashes(F.col("text"), p).alias("grams")), p), "grams")
    runs = grams.select("content", "size", "seeds", F.posexplode("grams").alias("_i", "gram")).select(
        "content", "size", "gram", (F.col("_i") < F.col("seeds")).alias("seed")
    )
    seeds = runs.filter("seed").select("gram", "content", "size")
    # (run, party) -> contents: each side of a possible pair, by the party that holds it.
    held = runs.join(holders, "content")
    several = F.count(F.lit(1)) > 1
    longest = held.groupBy("gram", "party_id").agg(F.max(F.struct("size", "content")).alias("_b"), several.alias("_several"))
    shortest = held.filter("seed").groupBy("gram", "party_id").agg(F.min(F.struct("size", "content")).alias("_a"), several.alias("_several"))

    upward = seeds.join(longest, "gram").filter(
        (F.col("_b.size") >= F.col("size")) & (F.col("_b.content") != F.col("content"))
    ).select(F.col("content").alias("a"), F.col("_b.content").alias("b")).distinct()
    known = _both_ways(written(_similar(upward, grams, p), "settled"), holders)
    downward = runs.join(shortest, "gram").filter(
        (F.col("_a.size") <= F.col("size")) & (F.col("_a.content") != F.col("content"))
    ).select(F.col("_a.content").alias("a"), F.col("content"), "party_id").distinct()
    downward = downward.join(known, ["content", "party_id"], "left_anti").select("a", F.col("content").alias("b")).distinct()
    known = known.unionByName(_both_ways(written(_similar(downward, grams, p), "settled"), holders)).distinct()

    open_up = (
        seeds.join(longest.filter("_several").select("gram", "party_id"), "gram")
        .join(known, ["content", "party_id"], "left_anti")
        .select("gram", "party_id", F.col("content").alias("a"), F.col("size").alias("_size"))
    )
    rest_up = open_up.join(held.withColumnRenamed("content", "b"), ["gram", "party_id"]).filter(
        (F.col("size") >= F.col("_size")) & (F.col("a") != F.col("b"))
    ).select("a", "b")
    open_down = (
        runs.join(shortest.filter("_several").select("gram", "party_id"), "gram")
        .join(known, ["content", "party_id"], "left_anti")
        .select("gram", "party_id", F.col("content").alias("b"), F.col("size").alias("_size"))
    )
    rest_down = open_down.join(held.filter("seed").withColumnRenamed("content", "a"), ["gram", "party_id"]).filter(
        (F.col("size") <= F.col("_size")) & (F.col("a") != F.col("b"))
    ).select("a", "b")
    late = _similar(rest_up.unionByName(rest_down).distinct(), grams, p)
    partners = known.unionByName(_both_ways(late, holders)).distinct().withColumnRenamed("party_id", "partner")
    return (
        hashed.select("document_id", "party_id", "content").join(partners, "content")
        .filter(F.col("partner") != F.col("party_id")).select("document_id", "party_id", "partner").distinct()
    )


def _rare_first(grams: DataFrame, p: Params) -> DataFrame:
    """(content, size, grams, seeds): how many runs a content has, those it shares with other contents from rare to common,
    and how many of them, from the first on, are among the rarest share of the content."""
    num, den = p.shared_text
    exploded = grams.select("content", F.size("grams").alias("size"), F.explode("grams").alias("gram"))
    common = exploded.withColumn("_df", F.count(F.lit(1)).over(Window.partitionBy("gram"))).filter(F.col("_df") > 1)
    rare = F.array_sort(F.collect_set(F.struct("_df", "gram")))  # a set: a row that stands twice in the table is read twice
    listed = common.groupBy("content", "size").agg(F.transform(rare, lambda e: e["gram"]).alias("grams"))
    # A run of one content can never meet a partner. Such runs are the rarest, so they fill the first places and only
    # their number matters: size minus the shared ones.
    seeds = F.greatest(F.lit(0), F.size("grams") - F.floor(F.col("size") * num / den).cast("int"))
    return listed.withColumn("seeds", seeds)


def _similar(pairs: DataFrame, grams: DataFrame, p: Params) -> DataFrame:
    """Pairs whose common runs are more than the given share of the shorter text's runs. Common runs are shared ones."""
    num, den = p.shared_text
    left = grams.select(F.col("content").alias("a"), F.col("grams").alias("_ga"), F.col("size").alias("_sa"))
    right = grams.select(F.col("content").alias("b"), F.col("grams").alias("_gb"), F.col("size").alias("_sb"))
    common = F.size(F.array_intersect("_ga", "_gb"))
    shorter = F.least("_sa", "_sb")
    return pairs.join(left, "a").join(right, "b").filter(den * common > num * shorter).select("a", "b")


def _both_ways(pairs: DataFrame, holders: DataFrame) -> DataFrame:
    """(content, party_id): parties holding a similar text, read from both ends of each pair."""
    ends = pairs.select(F.col("a").alias("content"), F.col("b").alias("_other")).unionByName(
        pairs.select(F.col("b").alias("content"), F.col("a").alias("_other"))
    )
    return ends.join(holders.withColumnRenamed("content", "_other"), "_other").select("content", "party_id").distinct()


# ---- promises -------------------------------------------------------------------------------------------------------


def programme_metrics(programmes: DataFrame, promises: DataFrame, themes: list[str]) -> DataFrame:
    """(party_id, document_id, promises, precise_n, precise_d, <theme>...) of the latest election's programmes.

    `programmes`: party_id, election, document_id. `promises`: document_id, horizon, measure, quote, theme (nullable).
    """
    latest = programmes.agg(F.max("election").alias("e")).scalar()
    precise = X.is_precise(F.col("horizon"), F.col("measure"), F.col("quote"))
    per_document = promises.groupBy("document_id").agg(
        F.count("*").alias("promises"), F.count_if(precise).alias("precise"),
        *[F.count_if(F.col("theme") == t).alias(t) for t in themes],
    )
    counts = ["promises", "precise", *themes]
    return (
        programmes.filter(F.col("election") == latest).select("party_id", "document_id").distinct()
        .join(per_document, "document_id", "left")
        .select("party_id", "document_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    )


def party_theme_table(programmes: DataFrame, promises: DataFrame, themes: list[str]) -> DataFrame:
    """Party x theme counts with the row total; a shared programme counts for each of its parties.

    Promises are counted per document and theme first, so the join carries counts, not promises.
    """
    per_document = promises.groupBy("document_id", F.coalesce("theme", F.lit("none")).alias("theme")).agg(
        F.count("*").alias("n")
    )
    joined = programmes.select("party_id", "document_id").distinct().join(per_document, "document_id")
    table = joined.groupBy("party_id").pivot("theme", [*themes, "none"]).agg(F.sum("n"))
    columns = [F.coalesce(F.col(c), F.lit(0)) for c in [*themes, "none"]]
    return table.select(
        "party_id", *[c.alias(n) for c, n in zip(columns, [*themes, "none"], strict=True)],
        sum(columns[1:], columns[0]).alias("total"),
    )


def current_promises(promises: DataFrame, documents: DataFrame, theme_rows: DataFrame) -> DataFrame:
    """Promises of current readings with their latest theme (NULL when none was given)."""
    readings = newest(documents, ["sha256"], [F.col("extraction").desc(), F.col("document_id")])
    themes = newest(theme_rows, ["promise_id"], [F.col("recorded_at").desc(), F.col("batch_id")])
    return promises.join(readings.select("document_id"), "document_id", "left_semi").join(
        themes.select("promise_id", "theme"), "promise_id", "left"
    )


def valid_labels(answers: DataFrame, allowed: list[str], size: int) -> DataFrame:
    """Adds `outcome` to (batch_id, ord, n, label): 'kept', 'repeated' or 'rejected'.

    n must be a whole number from 1 to the batch size, the label one of the allowed; the first valid answer per n wins.
    """
    number = F.when(F.trim("n").rlike("^[0-9]{1,9}$"), F.trim("n").cast("int"))
    valid = F.coalesce(number.between(1, size) & F.col("label").isin(*allowed), F.lit(False))
    judged = answers.withColumn("number", number).withColumn("_valid", valid)
    good = judged.filter("_valid")
    first = newest(good, ["batch_id", "number"], [F.col("ord")]).select("batch_id", "ord", F.lit(True).alias("_first"))
    return judged.join(first, ["batch_id", "ord"], "left").select(
        *answers.columns,
        F.when(~F.col("_valid"), "rejected").when(F.col("_first"), "kept").otherwise("repeated").alias("outcome"),
    )
