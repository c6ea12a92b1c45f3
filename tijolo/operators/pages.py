"""Listing cards out of stored pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

#: Rules are data. A card: its tag, and text that its attributes must hold. A field: the tag (None: any), attributes that must
#: equal a value, and the attribute that holds the field (None: the text inside).
CARD = ("li", {})
FIELDS = {"price": ("a", {}, None), "link": ("a", {}, "href")}
#: The six fields of a listing.
LISTING_CARD = ("div", {"class": ["card"]})
LISTING_FIELDS = {name: (None, {"data-field": name}, None) for name in ("price", "address", "area", "rooms", "baths", "parking")}
#: Elements without content, and elements that end where another of their kind begins, unless one of the others lies between.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS = {"li": ("ul", "ol"), "p": ("div", "article", "section", "li", "td"), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "dt": ("dl",), "dd": ("dl",), "option": ("select",)}

#: Rows that a worker holds before it hands them on; a page may hold very many cards, and a batch many pages.
ROWS = 2000

#: Elements that stand on lines of their own.
LINES = frozenset("article br dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p section table td th tr ul".split())


class _Cards(HTMLParser):
    """Keeps the open elements, each with the card and the fields that it begins; a field is that of the innermost open card."""

    def __init__(self, card: tuple, fields: dict):
        super().__init__(convert_charrefs=True)
        self.card, self.fields, self.cards = card, fields, []
        self.open: list[tuple[str, dict | None, list[tuple[dict, str]]]] = []

    def handle_starttag(self, tag, attrs):
        have = {k: v or "" for k, v in attrs}
        if tag in LINES:
            self.handle_data("\n")
        # an element ends where another of its kind begins, and a paragraph where any on lines of its own does
        for ended in {tag, "p"} if tag in LINES and tag != "br" else {tag}:
            self._end(ended)
        of, held = self.card
        begun = None
        if tag == of and all(w in have.get(k, "") for k, words in held.items() for w in words):
            begun = {}
            self.cards.append(begun)
        inner = begun if begun is not None else next((c for _, c, _ in reversed(self.open) if c is not None), None)
        reading = []
        if inner is not None:
            for name, (of, equal, attribute) in self.fields.items():
                if name not in inner and of in (None, tag) and all(have.get(k) == v for k, v in equal.items()):
                    inner[name] = have.get(attribute, "") if attribute else ""
                    if not attribute:
                        reading.append((inner, name))
        if tag not in VOID:
            self.open.append((tag, begun, reading))

    def _end(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1) if tag in ENDS else ():
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in ENDS[tag]:
                return

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in LINES:
            self.handle_data("\n")
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for _, _, reading in self.open:
            for card, name in reading:
                card[name] += data


def extract_cards(pages: DataFrame, card: tuple = CARD, fields: dict = FIELDS, needed: str = "price") -> DataFrame:
    """page_id, position and fields, a row for each card that has the needed field; other missing fields are `N/A`.

    A field is the first of its kind in its card, not in a card inside that card. An element that is not closed ends with the one around it.
    Line breaks become blanks. A page that cannot be parsed to its end gives the cards up to there; null html gives none.
    """
    names = ["page_id", "position", *fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for page_id, html in zip(pdf["page_id"], pdf["html"]):
                parser = _Cards(card, fields)
                try:
                    parser.feed(html or "")
                    parser.close()
                except (AssertionError, ValueError):
                    pass
                for i, c in enumerate(parser.cards):
                    value = {k: " ".join(c.get(k, "").split()) or "N/A" for k in fields}
                    if value[needed] != "N/A":
                        rows.append((page_id, i, *value.values()))
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    return pages.select("page_id", "html").mapInPandas(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, position int, {', '.join(f'{k} string' for k in fields)}")
