"""Visible text and links of HTML pages, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements whose text isn't shown.
HIDDEN = frozenset(["style", "script", "head", "title", "meta"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Page(HTMLParser):
    def __init__(self, hidden: frozenset[str]) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden, self.open, self.shown, self.links = hidden, [], [], []

    def handle_starttag(self, tag, attributes):
        if tag == "a":
            self.links += [value for key, value in attributes if key == "href" and value]
        if tag not in VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.hidden.intersection(self.open) and data.strip():
            self.shown.append(data.strip())


def _page(html: str) -> _Page:
    page = _Page(HIDDEN)
    page.feed(html)
    page.close()
    return page


class _Selected(HTMLParser):
    """The first attribute value, or the first text, of elements of a tag with given attributes."""

    def __init__(self, tag: str, where: dict[str, str], attribute: str | None) -> None:
        super().__init__(convert_charrefs=True)
        self.tag, self.where, self.attribute, self.found, self.inside = tag, where, attribute, None, 0

    def _fits(self, attributes: dict[str, str | None]) -> bool:
        # one of several classes is enough
        return all(v in (attributes.get(k) or "").split() if k == "class" else attributes.get(k) == v for k, v in self.where.items())

    def handle_starttag(self, tag, attributes):
        if self.inside and tag == self.tag:
            self.inside += 1
        elif tag == self.tag and self._fits(dict(attributes)):
            if self.attribute is None:
                self.inside = 1
            elif self.found is None:
                self.found = dict(attributes).get(self.attribute)

    def handle_endtag(self, tag):
        if self.inside and tag == self.tag:
            self.inside -= 1

    def handle_data(self, data):
        if self.inside and self.found is None:
            self.found = data


def selected(html: Column, tag: str, where: dict[str, str], attribute: str | None = None) -> Column:
    """Of the first element of a tag with these attributes that has it, the value of an attribute, or without one its first text; else null."""

    @F.pandas_udf("string")
    def first(pages: pd.Series) -> pd.Series:
        def one(page: str | None) -> str | None:
            if page is None:
                return None
            parser = _Selected(tag, where, attribute)
            parser.feed(page)
            parser.close()
            return parser.found

        return pages.map(one)

    return first(html)


def visible_text(html: Column) -> Column:
    """The shown text of a page, its pieces stripped and joined by spaces; comments don't count. Null stays null."""

    @F.pandas_udf("string")
    def shown(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else " ".join(_page(p).shown))

    return shown(html)


def links(html: Column) -> Column:
    """The targets of all links of a page in order."""

    @F.pandas_udf("array<string>")
    def targets(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: None if p is None else _page(p).links)

    return targets(html)


def matching_links(html: Column, pattern: str) -> Column:
    """The links that match a pattern."""
    return F.filter(links(html), lambda t: t.rlike(pattern))


def inner_url(link: Column, pattern: str = "(http.*html)") -> Column:
    """The address inside a link of an archive; '' if it has none."""
    return F.regexp_extract(link, pattern, 1)
