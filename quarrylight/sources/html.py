"""HTML pages to text, links and dates, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions.text import collapse_ws

DROPPED = "script|style|nav|footer|header|noscript"
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def visible_text(html: Column) -> Column:
    """Article text: dropped elements, comments and tags gone, block ends as line ends, common entities decoded."""
    text = F.regexp_replace(html, rf"(?is)<({DROPPED})\b[^>]*>.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"(?i)<br\s*/?>|</(p|div|li|h[1-6]|tr|article|section)\s*>", "\n")
    text = F.regexp_replace(text, r"<[^>]+>", " ")
    for entity, plain in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return collapse_ws(text, keep_newlines=True)


def title(html: Column) -> Column:
    return F.nullif(collapse_ws(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def links(html: Column, base: Column) -> Column:
    """Absolute addresses of the links, in order, distinct; fragments and script links left out."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*["']([^"'#]+)"""), 1)
    site = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"[^/]*$", "")

    def absolute(link: Column) -> Column:
        return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link)).when(link.startswith("/"), F.concat(site, link)).otherwise(F.concat(folder, link))

    return F.array_distinct(F.filter(F.transform(found, absolute), lambda x: ~x.rlike("(?i)^(javascript|mailto|data):")))


def page_date(html: Column) -> Column:
    """Date by precedence: meta, time element, first ISO date in the page."""
    meta = F.regexp_extract(html, r"""(?i)<meta[^>]+(?:published_time|date)["'][^>]+content=["'](\d{4}-\d\d-\d\d)""", 1)
    time = F.regexp_extract(html, r"""(?i)<time[^>]+datetime=["'](\d{4}-\d\d-\d\d)""", 1)
    return F.coalesce(*(F.nullif(x, F.lit("")).try_cast("date") for x in (meta, time, F.regexp_extract(html, r"\b(\d{4}-\d\d-\d\d)\b", 1))))


def slug(url: Column) -> Column:
    """The address as a file name."""
    return F.substring(F.trim(F.regexp_replace(F.lower(F.regexp_replace(url, r"^[a-z]+://", "")), r"[^a-z0-9]+", "-"), F.lit("-")), 1, 80)
