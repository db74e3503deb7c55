"""HTML as columns: body text, title, language and links, by patterns inside the JVM.

The body's text nodes are joined without separators, as the original does. For broken
markup there is `body_text_faithful`, an Arrow function over the standard HTML parser.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peneira.functions.text import collapse

# The entities that pages use most; the ampersand last.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&copy;": "©", "&middot;": "·", "&raquo;": "»", "&laquo;": "«", "&amp;": "&"}
DROPPED = ("script", "style", "noscript", "iframe")


def decode_entities(c: Column) -> Column:
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def body_text(html: Column) -> Column:
    """The body's text with white space collapsed; scripts, styles and frames dropped. Null stays null, a page without body is taken whole."""
    body = F.regexp_replace(html, "(?is)^.*?<body[^>]*>|</body>.*$", "")
    for tag in DROPPED:
        body = F.regexp_replace(body, f"(?is)<{tag}\\b.*?</{tag}\\s*>", "")
    body = F.regexp_replace(body, "(?s)<!--.*?-->", "")
    return collapse(decode_entities(F.regexp_replace(body, "<[^>]*>", "")))


def title(html: Column) -> Column:
    """The first title, trimmed; null if empty."""
    return F.nullif(F.trim(decode_entities(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))), F.lit(""))


def language(html: Column) -> Column:
    """The html element's lang; null if empty."""
    return F.nullif(F.regexp_extract(html, "(?is)<html[^>]*\\blang\\s*=\\s*[\"']?([^\"'\\s>]*)", 1), F.lit(""))


def hrefs(html: Column) -> Column:
    """The targets of all anchors in order, as written."""
    return F.transform(F.regexp_extract_all(html, F.lit("(?is)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1)), decode_entities)


class _Body(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0
        self.inside: bool | None = None

    def handle_starttag(self, tag: str, attrs) -> None:  # noqa: ANN001
        if tag == "body" and not self.inside:
            self.inside, self.parts = True, []
        self.hidden += tag in DROPPED

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "body":
            self.inside = False

    def handle_data(self, data: str) -> None:
        if not self.hidden and self.inside is not False:
            self.parts.append(data)


@F.pandas_udf(T.StringType())
def body_text_faithful(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """body_text by a real parser, for markup that patterns misread."""

    def one(page: str | None) -> str | None:
        if page is None:
            return None
        parser = _Body()
        parser.feed(page)
        return " ".join("".join(parser.parts).split())

    def each(values: Iterable[str | None]) -> pd.Series:
        return pd.Series([one(v) for v in values], dtype=object)

    for series in pages:
        yield each(series)
