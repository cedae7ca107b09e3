"""Catch-all pack: structured metadata over basic fields."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webgrain.operators.extract import generic_fields
from webgrain.operators.rules import Pack, PageRules, Values
from webgrain.operators.selectors import Page


def _read(page: Page, _chains: Column) -> Values:
    return generic_fields(page)


def _unify(_page: Page, e: Column) -> Values:
    return {
        "title": e.title, "text": e.text, "author": e.author, "media_urls": e.media_urls,
        "selectors_used": e.selectors_used, "description": e.description,
        "site_name": e.site_name, "published_date": e.published_date,
    }


GENERIC = Pack(
    name="generic_web",
    platforms=["generic"],
    url_patterns=[r"https?://.+"],
    page_type=lambda page: F.lit("article"),
    pages={"article": PageRules({"title": ["title"]}, _read, _unify)},
)
