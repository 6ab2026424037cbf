"""Text out of web pages. Many paragraphs aren't closed, so pages are cut at opening tags."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.operators.rows import found_rows

BLOCK = r"(?i)</?(?:p|h[1-6]|div|ul|ol|li|table|article|section|nav|footer|header|aside|script|style|body|html)\b[^>]*>"
SPACE = " \t\r\n"


def paragraphs(html: Column) -> Column:
    """Texts of the <p> elements, tags stripped, [n] marks cut, trimmed, without empty ones."""
    pieces = F.slice(F.split(html, r"(?i)<p(?:\s[^>]*)?>"), 2, 1 << 30)
    text = F.transform(pieces, lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.get(F.split(p, BLOCK), F.lit(0)), "<[^>]*>", ""), r"\[\d+\]", ""), F.lit(SPACE)))
    return F.filter(text, lambda p: p != "")


def extracted(pages: DataFrame, item: str = "page_id", html: str = "html", most: int = 10_000, title: str = r"(?is)<h1[^>]*>(.*?)</h1>") -> DataFrame:
    """(item, title, summary, content, n_paragraphs, status): the first two paragraphs over 50 characters, and all paragraphs up to `most` characters.
    A page without html is a failed row."""
    body = F.regexp_replace(F.col(html), r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "")
    rows = pages.select(item, F.col(html).isNotNull().alias("_ok"), F.trim(F.regexp_replace(F.regexp_extract(F.col(html), title, 1), "<[^>]*>", ""), F.lit(SPACE)).alias("title"), paragraphs(body).alias("_p"))
    return rows.select(
        item, "title", F.array_join(F.slice(F.filter("_p", lambda p: F.length(p) > 50), 1, 2), " ").alias("summary"),
        F.substring(F.array_join("_p", "\n"), 1, most).alias("content"), F.coalesce(F.size("_p"), F.lit(0)).alias("n_paragraphs"), F.when(F.col("_ok"), "fetched").otherwise("failed").alias("status"),
    )


#: A section whose title contains one of these ends the text.
STOP = {"references", "notes", "bibliography", "external links", "see also"}


class _Sections(HTMLParser):
    def __init__(self, least: int):
        super().__init__()
        self.least, self.out, self.kind, self.text, self.stopped = least, [], "", [], False

    def handle_starttag(self, tag, attrs):
        if tag in ("h2", "h3", "p", "ul"):
            self.close_block()
            self.kind = tag

    def handle_endtag(self, tag):
        if tag == self.kind:
            self.close_block()

    def handle_data(self, data):
        if self.kind:
            self.text.append(data)

    def close_block(self):
        text, kind = " ".join("".join(self.text).split()), self.kind
        self.kind, self.text = "", []
        if not text or self.stopped:
            return
        if kind == "h2" and any(t in text.lower() for t in STOP):
            self.stopped = True
            return
        if kind in ("h2", "h3"):
            self.out.append(("#" if kind == "h2" else "##") + f"Subheading:{text}")
        if kind != "h2" and len(text.split(" ")) > self.least and "." in text:
            self.out.append(text if text[-1] in ".?!" else text + ".")


def sections_of(html: str | None, least: int = 20, whole: bool = False) -> list[str]:
    parser = _Sections(least)
    parser.feed(html or "")
    parser.close_block()
    return parser.out if whole else parser.out[:10]


def sections(pages: DataFrame, item: str = "page_id", html: str = "html", least: int = 20, whole: bool = False) -> DataFrame:
    """(item, pos, text): headings (marked # and ##) and paragraphs of more than `least` words, up to the first h2 that has a title of STOP in it; the first ten unless whole.
    Nesting needs a parser, so this runs in Python."""
    return found_rows(pages, item, html, lambda h: sections_of(h, least, whole), "pos", "text")


def repaired(text: str | None) -> str:
    """Text whose escapes were read as Latin-1; an empty string if that fails."""
    try:
        return (text or "").encode().decode("unicode_escape").encode("latin1").decode()
    except (UnicodeDecodeError, UnicodeEncodeError):
        return ""


def mojibake_repaired(df: DataFrame, text: str) -> DataFrame:
    @F.pandas_udf("string")
    def fix(s: pd.Series) -> pd.Series:
        return s.map(repaired)

    return df.withColumn(text, fix(F.coalesce(text, F.lit(""))))


def page_views(events: DataFrame, key: str, value: str, at: str, first: str, last: str) -> DataFrame:
    """Sum of views of each key from the first day to the last; keys without any have 0 and are kept."""
    inside = F.col(at).between(F.lit(first).cast("timestamp"), F.lit(last).cast("timestamp"))
    return events.groupBy(key).agg(F.coalesce(F.round(F.sum(F.when(inside, F.col(value))), 6), F.lit(0.0)).alias("views"))


def title_matches(titles: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    """Titles that begin with a prefix in any case, the nearest first."""
    return titles.where(F.lower("title").startswith(prefix.lower())).orderBy(F.levenshtein("title", F.lit(prefix)), "title").limit(limit)


def search(pages: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Pages of a crawled table whose title or text has all words of the query, those with the most occurrences first."""
    words = [w.lower() for w in query.split()]
    text = F.lower(F.concat_ws(" ", "title", "content"))
    rows = pages
    for w in words:
        rows = rows.where(F.contains(text, F.lit(w)))
    count = sum((F.size(F.split(text, f"\\Q{w}\\E")) - 1 for w in words), F.lit(0))
    return rows.withColumn("hits", count).orderBy(F.col("hits").desc(), "title").limit(limit)
