"""URL normal form, resolution of links and path rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# scheme, authority, path, query, fragment
PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, PARTS, i)


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _query(query: Column) -> Column:
    """Parameters in order, re-encoded, without empty pieces and tracking (utm_*) ones."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    pairs = F.transform(
        pieces,
        lambda p: F.struct(
            _decoded(F.substring_index(p, "=", 1)).alias("k"),
            F.when(F.contains(p, F.lit("=")), _decoded(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v"),
        ),
    )
    kept = F.filter(pairs, lambda p: ~p["k"].startswith("utm_"))
    return F.array_join(F.transform(kept, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def normal_url(url: Column) -> Column:
    """Lower-case host, no fragment, no tracking parameters: one article, one address."""
    u = F.trim(url)
    query = _query(part(u, 4))
    scheme, host = F.lower(part(u, 1)), F.lower(part(u, 2))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""),
        part(u, 3),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def host(url: Column) -> Column:
    """Lower-case host name, without user and port."""
    return F.lower(F.regexp_replace(F.regexp_replace(part(F.trim(url), 2), "^.*@", ""), ":[0-9]*$", ""))


def _without_dots(path: Column) -> Column:
    """Resolves '.' and '..' segments."""
    last = F.element_at(F.split(path, "/"), -1)
    folded = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done)
        .when(s == "..", F.when(F.size(done) > 1, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(done))
        .otherwise(F.array_append(done, s)),
    )
    joined = F.array_join(folded, "/")
    return F.when(last.isin(".", "..") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve(base: Column, link: Column) -> Column:
    """Absolute address of a link found on the page at `base`."""
    origin = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    path = part(base, 3)
    folder = F.when(path == "", "/").otherwise(F.regexp_replace(path, "[^/]*$", ""))
    tail = F.regexp_extract(link, r"([?#].*)$", 1)
    own = F.regexp_replace(link, r"[?#].*$", "")
    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(part(base, 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(origin, _without_dots(own), tail))
        .when(link.startswith("?"), F.concat(origin, path, link))
        .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, own)), tail))
    )


def glob_pattern(glob: Column) -> Column:
    """Path glob (* and ?) as an anchored regular expression."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
