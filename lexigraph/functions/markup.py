"""HTML pages as links and text, in column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HREF = r'<a\s[^>]*?href="([^"]*)"'
# Named characters that pages use most, '&amp;' last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def html_links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, pos, href) of every link, from 0 in page order."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(HREF), 1)).alias("pos", "href"))


def html_text(html: Column) -> Column:
    """What a reader sees: no comments, head, scripts, styles or navigation; block ends as line breaks; entities undone once."""
    text = F.regexp_replace(html, r"(?is)<!--.*?(-->|$)|<(script|style|head|nav)\b.*?</\2\s*>", "")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|article|section)\s*>", "\n")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", "")
    text = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES.items(), text)
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\s*\n\s*", "\n"))
