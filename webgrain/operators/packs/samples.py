"""Sample packs: a third-party one and one made of list selectors."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webgrain.functions import scalars
from webgrain.operators.rules import Pack, PageRules, Values, used_selectors
from webgrain.operators.selectors import Page

# --- fixed values: selectors ----------------------------------------------------
ITEM = {
    "title": [".titleline > a", ".athing .titleline a"],
    "author_username": [".hnuser", "a.hnuser"],
    "text": [".comment .commtext", ".toptext"],
    "score": [".score"],
    "timestamp": [".age", ".age a"],
}
QUOTE_LISTS = {
    "quote_text": '.text[itemprop="text"]',
    "author_name": '.author[itemprop="author"]::text',
    "tags": ".tags a.tag::attr(href)",
}
# --- end of fixed values ----------------------------------------------------------


def _text(chain: Column) -> Column:
    return F.nullif(chain.value, F.lit(""))


def _read_item(_page: Page, c: Column) -> Values:
    return {
        "title": _text(c.title), "text": F.coalesce(_text(c.text), _text(c.title)),
        "author_username": _text(c.author_username),
        "score": scalars.parse_count(_text(c.score), "hackernews"),
        "age": _text(c.timestamp), "selectors_used": used_selectors(c, list(ITEM)),
    }


def _unify_item(_page: Page, e: Column) -> Values:
    return {
        "title": e.title, "text": e.text, "author": e.author_username, "likes": e.score,
        "selectors_used": e.selectors_used,
    }


def _read_quotes(page: Page, _c: Column) -> Values:
    return {name: page.values_of(selector) for name, selector in QUOTE_LISTS.items()}


def _unify_quotes(_page: Page, e: Column) -> Values:
    return {
        "tags": e.tags, "quote_text": F.to_json(e.quote_text), "author_name": F.to_json(e.author_name),
    }


HACKERNEWS = Pack(
    name="hackernews",
    platforms=["hackernews"],
    url_patterns=[r"https?://news\.ycombinator\.com/item\?id=\d+"],
    strategies=["http"],
    supports_ai_fallback=False,
    page_type=lambda page: F.lit("post"),
    pages={"post": PageRules(ITEM, _read_item, _unify_item)},
)
QUOTES = Pack(
    name="quotes_to_scrape_adapter",
    version="1.0.0",
    platforms=["quotes_to_scrape"],
    url_patterns=[r"https://quotes.toscrape.com/$"],
    generated=True,
    page_type=lambda page: F.lit("post"),
    pages={"post": PageRules({"quote_text": ['.text[itemprop="text"]']}, _read_quotes, _unify_quotes)},
)
