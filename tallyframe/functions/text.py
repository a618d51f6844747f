"""Text normal forms, fingerprints, mentions and lexical flags, as Spark expressions over whole texts.

Only two steps need Python: Unicode compatibility normalisation and named HTML entities. Both run as Arrow UDFs that
receive NULL for every text that plainly needs nothing, so the bulk of a corpus never crosses into Python.

Word characters are written [\\p{L}\\p{N}_] because \\w is ASCII-only in the JVM.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tallyframe.params import DEFAULT, Params



def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once per row. An expression captured by a lambda is otherwise computed again for
    every element the lambda visits."""
    return F.element_at(F.transform(F.array(value), body), 1)


WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = r"(?<![\p{L}\p{N}_])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(html.unescape(t)), na_action="ignore")


# Characters that compatibility normalisation may change; a text without any skips the UDF. The range of all that is not
# ASCII stands first, so most characters are passed over by one comparison.
UNSTABLE = "[\\x{80}-\\x{10FFFF}&&[^\\u00C0-\\u0131\\u2010\\u2012-\\u2015\\u2018-\\u201F\\u00AB\\u00BB\\u00BF\\u00A1-\\u00A7]]"


def beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.length(text)


def nfkc(text: Column) -> Column:
    return F.coalesce(_nfkc(F.when(beyond_ascii(text) & text.rlike(UNSTABLE), text)), text)


def unescape(text: Column) -> Column:
    """HTML entities, twice: some titles are encoded two times over."""
    return F.coalesce(_unescape(F.when(F.contains(text, F.lit("&")), text)), text)


# Zero-width characters, direction marks and soft hyphens.
INVISIBLE = "[\\u00AD\\u180E\\u200B-\\u200F\\u202A-\\u202E\\u2060-\\u2064\\u2066-\\u2069\\uFEFF]"


def clean_text(text: Column) -> Column:
    """Normalised text without invisible or control characters, single spaces, at most one blank line; '' for NULL."""
    t = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), INVISIBLE, "")
    t = F.regexp_replace(t, r"[\p{C}&&[^\n\t]]", "")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, " ?\n ?", "\n")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(t, "^[ \n]+|[ \n]+$", "")


# Signs read as one dash, one apostrophe and one quotation mark; the soft hyphen is dropped.
DASHES = "‐‑‒–—―−⁃﹘﹣－"
APOSTROPHES = "‘’‚‛ʼʹ´`′"
QUOTES = "“”„‟«»″"


def quote_form(text: Column) -> Column:
    """The form on which a quotation is compared: one sign per kind, single spaces, none around dashes or before
    closing punctuation, case folded."""
    return folded(nfkc(text))


def folded(normalised: Column) -> Column:
    """`quote_form` of a text that is NFKC already. Blanks are made single spaces first; what follows looks for spaces alone,
    and for a dash only where there is one."""
    signs = DASHES + APOSTROPHES + QUOTES + "\u00ad"
    plain = "-" * len(DASHES) + "'" * len(APOSTROPHES) + '"' * len(QUOTES)
    signed = F.when(beyond_ascii(normalised), F.translate(normalised, signs, plain)).otherwise(F.replace(normalised, F.lit("`"), F.lit("'")))
    t = F.regexp_replace(signed, r"(?U)\s\s+|[\s&&[^ ]]", " ")
    t = let(t, lambda e: F.when(F.contains(e, F.lit("-")), F.regexp_replace(e, " ?- ?", "-")).otherwise(e))
    t = F.regexp_replace(t, r" ([,.;:!?)\]])", "$1")
    t = F.trim(F.regexp_replace(t, r"([(\[]) ", "$1"))
    return F.replace(F.replace(F.lower(t), F.lit("ß"), F.lit("ss")), F.lit("ς"), F.lit("σ"))


# White space, and the signs put around a quotation.
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
AROUND = "\"'«»“”‘’"


def bare_quote(text: Column) -> Column:
    """Without the spaces and quotation marks put around a quotation."""
    return F.btrim(F.btrim(F.btrim(text, F.lit(BLANKS)), F.lit(AROUND)), F.lit(BLANKS))


def _accent_table() -> tuple[str, str]:
    """Accented Latin, Greek and Cyrillic letters and their base letters, derived from canonical decomposition."""
    pairs = []
    for code in (*range(0x00C0, 0x0250), *range(0x0370, 0x0500), *range(0x1E00, 0x2000)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, BASE = _accent_table()


def base_letters(text: Column) -> Column:
    """Lower case, accented letters replaced one by one: every character keeps its place."""
    return F.translate(F.lower(F.translate(text, "İ", "I")), ACCENTED, BASE)


def accentless(text: Column) -> Column:
    return F.regexp_replace(base_letters(text), r"\p{Mn}", "")


def clean_title(text: Column) -> Column:
    """Readable act title: no type suffix, entities or tags; NULL when nothing is left."""
    t = F.regexp_replace(F.trim(text), r"\^\^<?https?://\S+$", "")
    t = F.regexp_replace(unescape(t), "<[^>]+>", "")
    t = F.replace(F.replace(t, F.lit(" "), F.lit(" ")), F.lit('\\"'), F.lit('"'))
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.nullif(t, F.lit(""))


DECREE = rf"decreto-legge ([0-9]{{1,2}}°? {WORD}+ [0-9]{{4}}), n\. ?([0-9]+)"


def law_key(clean: Column) -> Column:
    """The same law in two chambers: the decree's number for conversions, else the whole bare title."""
    title = F.coalesce(clean, F.lit(""))
    decree = F.lower(
        F.concat(
            F.lit("decreto-legge "), F.replace(F.regexp_extract(title, DECREE, 1), F.lit("°"), F.lit("")),
            F.lit(" n "), F.regexp_extract(title, DECREE, 2),
        )
    )
    bare = F.regexp_replace(title, r"^S\. ?[0-9]+\. ?- ?", "")
    bare = F.regexp_replace(bare, r"(\s*\([^()]*\))+\s*$", "")
    bare = F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}_]+", " "))
    return F.when(title.rlike(DECREE), decree).otherwise(bare)


def fingerprint(*parts: Column) -> Column:
    """sha256 of the parts joined by newlines, NULL as empty."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD}+)"), F.lit(1))


def shingles(text: Column, p: Params = DEFAULT) -> Column:
    """Distinct runs of consecutive words; empty when the text is shorter than one run."""
    k = p.shingle_words

    def runs(tokens: Column) -> Column:
        last = F.size(tokens) - (k - 1)
        made = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(tokens, i, k), " "))
        return F.when(last >= 1, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))

    return let(words(text), runs)


def shingle_hashes(text: Column, p: Params = DEFAULT) -> Column:
    """`shingles` as numbers of 64 bits, made of the words' own."""
    k = p.shingle_words

    def runs(hashes: Column) -> Column:
        last = F.size(hashes) - (k - 1)
        made = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(hashes, i, k)))
        return F.when(last >= 1, F.array_distinct(made)).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), runs)


# Phrases that address a language model rather than a reader, tried in this order.
ADDRESSED = (
    r"ignora\s+(tutte\s+)?(le\s+)?istruzioni",
    r"ignore\s+(all\s+)?(the\s+)?(previous|prior|above)\s+instructions",
    r"system\s+prompt",
    r"(sei|you\s+are)\s+(ora\s+|now\s+)?(un|an?)\s+(modello\s+linguistico|assistente|ai\b|language\s+model|assistant)",
    r"(classifica|valuta|considera)\s+quest[oa]\s+(dichiarazione|testo|documento)\s+come",
    r"<\|im_start\|>|\[/?INST\]|<<SYS>>",
)


def suspicious_phrase(text: Column) -> Column:
    """First phrase found, by pattern order, whole; NULL when none is."""
    found = [F.nullif(F.regexp_extract(text, f"(?i){p}", 0), F.lit("")) for p in ADDRESSED]
    return F.coalesce(*found)


# What counts as a deadline and as a year.
DEADLINE = r"(?i)[0-9]|legislatura|\b(due|tre|quattro|cinque|sei|sette|otto|nove|dieci|cento)\b"
YEAR = r"\b(19|20)[0-9][0-9]\b"


def is_precise(horizon: Column, measure: Column, quote: Column) -> Column:
    """A deadline with a number, and a figure other than a year in the measure or the quotation."""
    figures = [F.regexp_replace(F.coalesce(t, F.lit("")), YEAR, " ").rlike("[0-9]") for t in (measure, quote)]
    return F.coalesce(horizon.rlike(DEADLINE), F.lit(False)) & (figures[0] | figures[1])


def _one_apostrophe(text: Column) -> Column:
    return F.translate(text, "’‘", "''")


def _alternation(forms: list[str]) -> str:
    longest_first = sorted({f.replace("’", "'").replace("‘", "'") for f in forms}, key=lambda f: (-len(f), f))
    return f"{NOT_AFTER_WORD}({'|'.join(re.escape(f) for f in longest_first)}){NOT_BEFORE_WORD}"


def mentions(text: Column, forms: dict[str, list[str]]) -> Column:
    """Sorted identifiers whose listed name forms occur as whole words, any case.

    One alternation over all forms is tried first, so texts that name nobody cost one pass.
    """
    t = _one_apostrophe(text)
    every = [f for fs in forms.values() for f in fs]
    found = F.array_compact(
        F.array(*[F.when(t.rlike("(?iu)" + _alternation(fs)), F.lit(i)) for i, fs in sorted(forms.items()) if fs])
    )
    return F.when(t.rlike("(?iu)" + _alternation(every)), found).otherwise(F.array().cast("array<string>"))


def names_anyone(text: Column, forms: dict[str, list[str]], surnames: list[str]) -> Column:
    """Any listed form, or a surname with its capital as written."""
    t = _one_apostrophe(text)
    every = [f for fs in forms.values() for f in fs]
    hit = t.rlike("(?iu)" + _alternation(every))
    return hit | t.rlike(_alternation(surnames)) if surnames else hit


# Publisher's reservation against mining, as a page declares it.
RESERVED_META = "(?i)<meta[^>]+name=[\"']tdm-reservation[\"'][^>]+content=[\"']1[\"']"


def reserves_rights(html_text: Column) -> Column:
    return html_text.rlike(RESERVED_META)


def json_in_words(value: Column) -> Column:
    """Field `testo` of an object, the text of a JSON string, else the JSON as it stands."""
    field = F.get_json_object(value, "$.testo")
    string = F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")
    return F.when(F.trim(value).startswith("{") & field.isNotNull(), field).when(
        F.trim(value).startswith('"'), string
    ).otherwise(value)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(accentless(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def first_hop(forwarded: Column) -> Column:
    return F.coalesce(F.trim(F.get(F.split(forwarded, ","), F.lit(0))), F.lit(""))


def daily_origin(forwarded: Column, day: Column) -> Column:
    """Code of a sender that changes every day: the address itself is never kept."""
    return F.sha2(F.concat_ws("|", first_hop(forwarded), day.cast("string")), 256)


def forbidden_stems(text: Column, stems: list[str]) -> Column:
    """Stems of a lexicon that start a word of the text, sorted."""
    hit = [F.when(F.lower(text).rlike(rf"(^|[^\p{{L}}]){re.escape(s.lower())}"), F.lit(s)) for s in sorted(stems)]
    return F.array_compact(F.array(*hit))


# What is no phrase (comments), quoted strings with a blank inside, and text after a tag.
COMMENT = r"<!--[\s\S]*?-->|/\*[\s\S]*?\*/"
LINE_COMMENT = r"(?m)(^|[ \t\r\n\f])//[ \t\r\f].*$"
QUOTED = "|".join(rf"{q}(?:[^{q}\n]*\n[^{q}\n]*|[^{q} \t\r\n\f]*[ \t\r\f][^{q}\n]*){q}" for q in ('"', "'")) + r"|`[^`]*[ \t\r\n\f][^`]*`"
TAG_TEXT = r"(?:<[A-Za-z][A-Za-z0-9_-]*(?:[ \t\r\n\f][^<>]*)?>|</[A-Za-z][A-Za-z0-9_-]*>)([^<>{}]*[A-Za-zàèéìòùÀÈÉÌÒÙ][^<>{}]*)"


def visible_phrases(source: Column) -> Column:
    """The phrases of a source text that a visitor may read, in two runs: quoted strings with a blank inside, without their
    quotes, then the text that follows a tag. Comments are taken out first; a NULL has none."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(source, F.lit("")), COMMENT, " "), LINE_COMMENT, " ")

    def found(t: Column) -> Column:
        quoted = F.transform(F.regexp_extract_all(t, F.lit(QUOTED), F.lit(0)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))
        return F.concat(quoted, F.regexp_extract_all(t, F.lit(TAG_TEXT), F.lit(1)))

    return let(bare, found)


def any_case_in(value: Column, names: list[str]) -> Column:
    """Whether a value is one of the names, letter case aside; false for NULL."""
    return F.coalesce(F.lower(value).isin(*sorted({n.lower() for n in names})), F.lit(False))


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    """Whether a value begins with one of the prefixes, as written; false for NULL."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | value.startswith(p)
    return F.coalesce(hit, F.lit(False))


def unbound(value: Column) -> Column:
    """Whether a source left a value out: NULL, or nothing but blanks."""
    return F.trim(F.coalesce(value.cast("string"), F.lit(""))) == ""
