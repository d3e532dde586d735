"""Fields of HTML pages and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def title_of(html: Column) -> Column:
    """Contents of the title element, else of the first h1."""
    first = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)
    head = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<h1[^>]*>(.*?)</h1>", 1)
    return F.when(first != "", first).otherwise(head)


def meta(html: Column, name: str) -> Column:
    """Contents of all meta elements of that name, in order (name before content or after)."""
    text = F.coalesce(html, F.lit(""))
    quoted = name.replace(".", r"\.")
    ahead = F.regexp_extract_all(text, F.lit(rf"(?is)<meta[^>]*\bname=[\"']{quoted}[\"'][^>]*\bcontent=[\"']([^\"']*)[\"']"), F.lit(1))
    behind = F.regexp_extract_all(text, F.lit(rf"(?is)<meta[^>]*\bcontent=[\"']([^\"']*)[\"'][^>]*\bname=[\"']{quoted}[\"']"), F.lit(1))
    return F.concat(ahead, behind)


def hrefs(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a[^>]*\bhref=[\"']([^\"']*)[\"']"), F.lit(1)))


#: Entities that text keeps most often.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def visible(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space collapsed."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style|noscript)[^>]*>.*?</\1>|<!--.*?-->", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def next_line(text: Column, label: str) -> Column:
    """What follows a label on its line, or else the next line that isn't blank."""
    return F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), rf"(?imu)^[ \t]*{label}[ \t]*:?[ \t]*(?:\r?\n\s*)?(\S[^\n]*)$", 1))


def url_parts(url: Column) -> dict[str, Column]:
    part = lambda p: F.try_parse_url(url, F.lit(p))
    return {"scheme": part("PROTOCOL"), "host": part("HOST"), "path": part("PATH"), "query": part("QUERY")}


def redirect_target(url: Column) -> Column:
    """The target of a search engine's redirect: parameter u, after its first two characters, is URL-safe base64."""
    raw = F.substring(F.try_parse_url(url, F.lit("QUERY"), F.lit("u")), 3, 100_000)
    plain = F.translate(raw, "-_", "+/")
    return F.decode(F.try_to_binary(F.rpad(plain, (F.ceil(F.char_length(plain) / 4) * 4).cast("int"), F.lit("=")), F.lit("base64")), "UTF-8")
