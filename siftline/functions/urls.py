"""URLs as columns: keys for merging, domains, and the targets of redirects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(c: Column) -> Column:
    """Merge key: without query, fragment, scheme, www. and closing slashes, lower-cased."""
    x = F.substring_index(F.substring_index(c, "?", 1), "#", 1)
    for part in ("https://", "http://", "www."):
        x = F.replace(x, F.lit(part), F.lit(""))
    return F.lower(F.regexp_replace(x, "/+$", ""))


def engine_key(c: Column) -> Column:
    """Key within one engine's list: scheme and www. stay."""
    return F.lower(F.regexp_replace(F.substring_index(F.substring_index(c, "?", 1), "#", 1), "/+$", ""))


def authority(c: Column) -> Column:
    return F.coalesce(F.try_parse_url(c, F.lit("AUTHORITY")), F.lit(""))


def domain(c: Column) -> Column:
    return F.replace(authority(c), F.lit("www."), F.lit(""))


def unwrapped_a(href: Column) -> Column:
    """Target of a click-through link of engine A: parameter u, base64 after ``a1``, else r, else the link itself. Tabs and line breaks in a link count for nothing."""
    flat = F.translate(href, "\t\r\n", "")
    raw = F.regexp_replace(F.try_url_decode(F.try_parse_url(flat, F.lit("QUERY"), F.lit("u"))), "^a1", "")
    code = F.translate(raw, "-_", "+/")
    padded = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), "=")
    target = F.try_to_binary(padded, F.lit("base64"))
    text = F.when(F.is_valid_utf8(target.cast("string")), target.cast("string"))
    other = F.try_url_decode(F.try_parse_url(flat, F.lit("QUERY"), F.lit("r")))
    link = F.when(text.startswith("http"), text).when(other.startswith("http"), other).otherwise(href)
    return F.when(F.contains(href, F.lit("bing.com/ck/a")), link).otherwise(href)


def unwrapped_b(href: Column) -> Column:
    """Target of a click-through link of engine B: parameter uddg, else the link itself."""
    wrapped = F.contains(href, F.lit("duckduckgo.com")) & F.contains(href, F.lit("uddg="))
    return F.when(wrapped, F.coalesce(F.try_url_decode(F.try_parse_url(href, F.lit("QUERY"), F.lit("uddg"))), href)).otherwise(href)


def admitted(href: Column, title: Column) -> Column:
    """Whether engine A's unwrapped hit counts: a title, a web address, not one of the engine's own hosts."""
    own = F.regexp_replace(authority(href), r":\d+$", "").rlike(r"(?:bing\.com|microsoft\.com)$")
    return (F.coalesce(title, F.lit("")) != "") & F.coalesce(href.startswith("http"), F.lit(False)) & ~own
