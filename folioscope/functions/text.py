"""Text expressions: words, hosts, titles, loose matching."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The host of a URL, '' if there is none."""
    return F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1))


def language_segment(url: Column) -> Column:
    """A two-letter first path segment, '' if there is none."""
    return F.regexp_extract(url, "^[a-z]+://[^/]+/([a-z][a-z])([/?#].*)?$", 1)


def html_title(html: Column) -> Column:
    """The text of the first title element as it stands, '' if there is none."""
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def words(text: Column) -> Column:
    """Pieces between single spaces, empty ones dropped."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def holds(text: Column, term: str) -> Column:
    """Whether the text contains the term, in any case."""
    return F.contains(F.lower(text), F.lit(term.lower()))


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def port(text: Column) -> Column:
    """A port number from decimal digits, null unless it is one of 1 to 65534."""
    n = F.when(F.rlike(text, F.lit("^[0-9]+$")), F.try_to_number(F.right(text, F.lit(18)), F.lit("999999999999999999")).cast("long"))
    return F.when((F.length(text) <= 18) & n.between(1, 65534), n)


def settings(json: Column) -> Column:
    """A JSON object of plain values as a map from names to texts; null if it is none."""
    return F.from_json(json, "map<string,string>")


def setting(values: Column, name: str, default: str) -> Column:
    """A name's value, or ``default`` where the name isn't there; null where it is there without a value."""
    return F.when(F.map_contains_key(values, name), F.element_at(values, F.lit(name))).otherwise(F.lit(default))
