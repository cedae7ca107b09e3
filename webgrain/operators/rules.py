"""Rule packs: URL patterns, selector chains and field maps per page type."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webgrain.functions.text import let
from webgrain.operators.dom import parse_page
from webgrain.operators.normalize import unified_struct
from webgrain.operators.selectors import Page

Values = dict[str, Column]


@dataclass(frozen=True, eq=False)
class PageRules:
    """How to read one type of page.

    ``chains`` are ordered selectors per field.  ``read`` turns the page and the
    bound chain results into extracted values; ``unify`` maps those to unified
    columns (anything else it returns ends up in ``metadata``).
    """

    chains: dict[str, list[str]]
    read: Callable[[Page, Column], Values]
    unify: Callable[[Page, Column], Values]


@dataclass(frozen=True)
class Pack:
    """A rule pack; everything a user needs to add a site."""

    name: str
    platforms: list[str]
    url_patterns: list[str]
    pages: dict[str, PageRules]
    page_type: Callable[[Page], Column]
    version: str = "0.1.0"
    strategies: list[str] = field(default_factory=lambda: ["http", "browser"])
    requires_auth: bool = False
    supports_ai_fallback: bool = True
    generated: bool = False
    confidence: float = 0.0


def check_pack(pack: Pack) -> None:
    """L2: a pack needs a name, a platform and a URL pattern."""
    if not isinstance(pack, Pack):
        raise TypeError(f"expected a Pack, got {type(pack).__name__}")
    if not pack.platforms:
        raise ValueError(f"pack {pack.name} must declare at least one platform")
    if not pack.url_patterns:
        raise ValueError(f"pack {pack.name} must declare at least one URL pattern")


def bound_chains(page: Page, chains: dict[str, list[str]]) -> Column:
    """All chains of a page type as one struct column."""
    return F.struct(*[page.chain(selectors).alias(name) for name, selectors in chains.items()])


def used_selectors(chains: Column, names: list[str]) -> Column:
    """Selectors that matched, in field order."""
    return F.filter(
        F.array(*[chains[n].selector for n in names]), lambda s: s.isNotNull()
    )


def read_page(page: Page, rules: PageRules, then: Callable[[Column], Column] | None = None) -> Column:
    """Extracted values of one page as a struct; ``then`` maps the bound struct further."""

    def values(chains: Column) -> Column:
        out = F.struct(*[c.alias(n) for n, c in rules.read(page, chains).items()])
        return out if then is None else let(out, then)

    return let(bound_chains(page, rules.chains), values)


def unify_page(page: Page, pack: Pack, page_type: str, strategy: Column) -> Column:
    """Unified record of one page of a known type."""
    rules = pack.pages[page_type]

    def unify(values: Column) -> Column:
        mapped = rules.unify(page, values)
        mapped.setdefault("content_type", F.lit(page_type))
        return unified_struct(
            {"url": page.url, "platform": F.lit(pack.platforms[0]), "scraping_strategy": strategy, **mapped}
        )

    return read_page(page, rules, unify)


def with_parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``parsed`` and drop the raw text, which nothing downstream reads."""
    return pages.withColumn("parsed", parse_page(F.col(html))).drop(html)


def extract_pack(pages: DataFrame, pack: Pack, page_type: str, url: str = "url", *,
                 fields: list[str] | None = None) -> DataFrame:
    """Rows of one page type with their extracted values (``parsed`` is used up).

    ``fields`` names the values of the struct, all of the page type's by default.  Spark makes a struct
    as a whole once two of its costly values are read: name those that are needed.
    """
    page, rules = Page("parsed", F.col(url)), pack.pages[page_type]
    rest = [c for c in pages.columns if c != "parsed"]
    # A column for each chain: Spark compiles it, takes it once, and drops it where nothing reads it.
    bound = pages.select(*rest, "parsed", *[page.chain(selectors).alias(f"__chain_{n}") for n, selectors in rules.chains.items()])
    values = rules.read(page, F.struct(*[F.col(f"__chain_{n}").alias(n) for n in rules.chains]))
    return bound.select(*rest, F.struct(*[values[n].alias(n) for n in (values if fields is None else fields)]).alias("fields"))


def extract_unified(pages: DataFrame, packs: list[Pack], *, url: str = "url", platform: str = "platform",
                    strategy: str = "strategy") -> DataFrame:
    """Unified records of a mixed table in one pass: every row runs only its own rules.

    ``pages``: parsed, url, platform, strategy.  Rows of other platforms get NULL.
    """
    page = Page("parsed", F.col(url))
    kinds, ladder = None, None
    for pack in packs:
        ours = F.col(platform).isin(pack.platforms)
        kind = pack.page_type(page)
        kinds = F.when(ours, kind) if kinds is None else kinds.when(ours, kind)
        for rules in dict.fromkeys(pack.pages.values()):
            shared = [k for k, r in pack.pages.items() if r is rules]
            test = ours & F.col("page_type").isin(shared)
            value = unify_page(page, pack, shared[0], F.col(strategy))
            ladder = F.when(test, value) if ladder is None else ladder.when(test, value)
    rest = [c for c in pages.columns if c != "parsed"]
    typed = pages.withColumn("page_type", kinds)
    return typed.select(*rest, ladder.alias("record"))


# --- catalogues and scores ------------------------------------------------------
def pack_table(spark: SparkSession, packs: list[Pack]) -> DataFrame:
    """One row per pack: name, version, platforms, pattern count, strategies, flags."""
    rows = [
        (p.name, p.version, p.platforms, p.url_patterns, p.strategies, p.requires_auth,
         p.supports_ai_fallback, p.confidence)
        for p in packs
    ]
    return spark.createDataFrame(
        rows,
        "name string, version string, platforms array<string>, url_patterns array<string>, "
        "strategies array<string>, requires_auth boolean, supports_ai_fallback boolean, confidence double",
    )


def rule_table(spark: SparkSession, packs: list[Pack]) -> DataFrame:
    """All selectors as rows (pack, content_type, field, ord, selector)."""
    rows = [
        (p.name, kind, name, i, s)
        for p in packs for kind, rules in p.pages.items()
        for name, chain in rules.chains.items() for i, s in enumerate(chain)
    ]
    return spark.createDataFrame(
        rows, "pack string, content_type string, field string, ord int, selector string"
    )


def catalogue(packs: DataFrame) -> DataFrame:
    """Distinct packs by name."""
    return packs.dropDuplicates(["name"])


def health_report(packs: DataFrame) -> DataFrame:
    """Pattern counts and flags per pack."""
    return packs.select(
        "name", "version", "platforms", F.size("url_patterns").alias("url_patterns"), "strategies",
        "requires_auth", "supports_ai_fallback",
    )


def score_rules(pages: DataFrame, rules: PageRules, required: list[str]) -> DataFrame:
    """How well a rule set fits a table of parsed pages.

    One row: pages, selectors, matched selectors (with a match on any page),
    missing required fields (empty on every page), score.  Score: 0.2 for rules
    that compile, 0.2 for no missing field, 0.4 for running, and 0.2 times the
    share of matched selectors.
    """
    page = Page("parsed")
    selectors = [s for chain in rules.chains.values() for s in chain]
    hits = [
        F.coalesce(F.max(F.size(page.select(s))), F.lit(0)).alias(f"h{i}")
        for i, s in enumerate(selectors)
    ]
    filled = [
        F.coalesce(F.max(F.coalesce(page.chain(rules.chains[f]).value, F.lit("")) != ""), F.lit(False)).alias(f"f{i}")
        if f in rules.chains else F.lit(False).alias(f"f{i}")
        for i, f in enumerate(required)
    ]
    flat = pages.agg(F.count(F.lit(1)).alias("pages"), *hits, *filled)
    matched = F.size(F.filter(F.array(*[F.col(f"h{i}") for i in range(len(selectors))]), lambda h: h > 0))
    missing = F.filter(
        F.array(*[F.when(~F.col(f"f{i}"), F.lit(f)) for i, f in enumerate(required)]),
        lambda f: f.isNotNull(),
    )
    return flat.select(
        "pages", F.lit(len(selectors)).alias("selectors"), matched.alias("matched"),
        F.array_join(missing, ",").alias("missing"),
        F.round(
            F.lit(0.6) + F.when(F.size(missing) == 0, 0.2).otherwise(0.0)
            + 0.2 * matched / len(selectors), 2
        ).alias("score"),
    )


def field_expectations(values: DataFrame) -> DataFrame:
    """Expected type per field from a long table (field, kind, value).

    ``kind`` is the stored type name ('list', 'number', 'string', 'other'); a
    boolean counts as a number.  The latest row per field decides.
    """
    expected = (
        F.when(F.col("kind") == "list", "list")
        .when(F.col("kind").isin("number", "boolean"), "number")
        .when((F.col("kind") == "string") & (F.trim("value") != ""), "string")
        .when(F.col("value").isNull(), "optional")
        .otherwise("present")
    )
    rows = values.filter(~F.col("field").endswith("_confidence") & (F.col("field") != "selectors_used"))
    return rows.groupBy("field").agg(F.max_by(expected, "seq").alias("expected"))


def expectation_failures(values: DataFrame, expectations: DataFrame) -> DataFrame:
    """Rows that break their field's expectation."""
    ok = (
        F.when(F.col("expected") == "list", F.col("kind") == "list")
        .when(F.col("expected") == "number", F.col("kind").isin("number", "boolean"))
        .when(F.col("expected") == "string", (F.col("kind") == "string") & (F.trim(F.coalesce("value", F.lit(""))) != ""))
        .when(F.col("expected") == "present", F.col("value").isNotNull())
        .otherwise(F.lit(True))
    )
    return values.join(expectations, "field").filter(~F.coalesce(ok, F.lit(False)))
