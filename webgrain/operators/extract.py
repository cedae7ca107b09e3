"""Field extraction that does not depend on a platform."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from webgrain.functions.scalars import parse_count
from webgrain.functions.text import let, strip
from webgrain.operators.selectors import Page

# --- fixed values -----------------------------------------------------------
BASIC_SELECTORS = ["title", "body", "meta[property='og:image']"]
NOISE_TAGS = ["script", "style", "nav", "footer", "header", "aside"]
NEXT_PAGE_SELECTORS = [
    'a[rel="next"]', 'a[aria-label="Next page"]', 'a[aria-label="Next"]',
    'button[aria-label="Next page"]', 'button[aria-label="Next"]',
    'a:has-text("Next")', 'a:has-text(">")', 'a:has-text("→")',
    'button:has-text("Next")', 'button:has-text("Load more")', 'a:has-text("Load more")',
]
CHUNK_TOKENS = 12000
# --- end of fixed values ----------------------------------------------------

# Nodes that the basic and the metadata extraction read.
BASIC_TAGS = ["title", "body", "meta"]
ARTICLE_TAGS = [*BASIC_TAGS, "main", "article", *NOISE_TAGS]


def basic_fields(page: Page) -> dict[str, Column]:
    """Title, body text, og:image; the author is never known here."""
    image = page.first_attr("meta[property='og:image']", "content")
    none = F.lit(None).cast("string")
    return {
        "title": page.first_text("title"),
        "text": F.coalesce(page.first_text("body", " "), F.lit("")),
        "author": none,
        "media_urls": F.filter(F.array(image), lambda v: v != ""),
        "selectors_used": F.array(*[F.lit(s) for s in BASIC_SELECTORS]),
    }


def open_graph(page: Page) -> dict[str, Column]:
    """Og:title, og:description, og:image, og:site_name."""
    return {
        "title": page.meta("og:title"), "description": page.meta("og:description"),
        "image": page.meta("og:image"), "site_name": page.meta("og:site_name"),
    }


def json_ld(page: Page) -> Column:
    """C4: fold all JSON-LD objects in document order.

    struct(title, author, published, site_name), each struct(seen, v).  The first
    headline and the first publisher count; later scripts replace author and
    date.  Broken JSON and anything but objects is skipped.
    """
    scripts = F.transform(
        F.filter(
            page.dom,
            lambda n: (n.tag == "script")
            & F.coalesce(n.attrs.getItem("type") == "application/ld+json", F.lit(False)),
        ),
        lambda n: F.when(strip(n.raw).startswith("{"), F.try_parse_json(n.raw)),
    )
    objects = F.filter(scripts, lambda v: v.isNotNull())

    def cell(seen: Column, value: Column) -> Column:
        return F.struct(seen.alias("seen"), value.cast("string").alias("v"))

    nothing = cell(F.lit(False), F.lit(None))
    start = F.struct(
        *[nothing.alias(n) for n in ("title", "author", "published", "site_name")]
    )

    def has(v: Column, path: str) -> Column:
        return F.try_variant_get(v, path, "variant").isNotNull()

    def text(v: Column, path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    def kind(v: Column, path: str) -> Column:
        return F.coalesce(
            F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("")
        )

    def step(acc: Column, v: Column) -> Column:
        author_object = kind(v, "$.author").startswith("OBJECT")
        first_object = kind(v, "$.author[0]").startswith("OBJECT")
        return F.struct(
            F.when(~acc.title.seen & has(v, "$.headline"), cell(F.lit(True), text(v, "$.headline")))
            .otherwise(acc.title).alias("title"),
            F.when(author_object, cell(F.lit(True), text(v, "$.author.name")))
            .when(first_object, cell(F.lit(True), text(v, "$.author[0].name")))
            .otherwise(acc.author).alias("author"),
            F.when(has(v, "$.datePublished"), cell(F.lit(True), text(v, "$.datePublished")))
            .otherwise(acc.published).alias("published"),
            F.when(
                ~acc.site_name.seen & kind(v, "$.publisher").startswith("OBJECT"),
                cell(F.lit(True), text(v, "$.publisher.name")),
            ).otherwise(acc.site_name).alias("site_name"),
        )

    return F.aggregate(objects, start, step)


def main_text(page: Page) -> Column:
    """Text of main, article or body without navigation and the like."""
    noise = F.transform(
        F.filter(page.dom, lambda n: n.tag.isin(NOISE_TAGS)),
        lambda n: F.struct(n.id.alias("id"), n.last.alias("last"), n.t0.alias("t0"), n.t1.alias("t1")),
    )

    def read(cut: Column) -> Column:
        def root(tag: str) -> Column:
            return F.get(
                F.filter(
                    page.dom,
                    lambda n: (n.tag == tag)
                    & ~F.exists(cut, lambda c: (c.id <= n.id) & (n.id <= c.last)),
                ),
                F.lit(0),
            )

        def span(node: Column) -> Column:
            return F.when(
                node.isNotNull(), F.struct(node.t0.alias("t0"), node.t1.alias("t1"))
            )

        whole = F.struct(F.lit(0).alias("t0"), F.size(page.texts).alias("t1"))
        chosen = F.coalesce(span(root("main")), span(root("article")), span(root("body")), whole)
        # Outermost noise only, in document order; the text between two of them is one slice.
        start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("from"), F.array().cast("array<int>").alias("to"))

        def outer(acc: Column, c: Column) -> Column:
            return F.when(c.t1 <= acc.upto, acc).otherwise(F.struct(
                c.t1.alias("upto"), F.concat(acc["from"], F.array(acc.upto)).alias("from"),
                F.concat(acc.to, F.array(F.greatest(c.t0, acc.upto))).alias("to")))

        def texts(both: Column) -> Column:
            gaps = F.zip_with(
                F.concat(both.g["from"], F.array(both.g.upto)), F.concat(both.g.to, F.array(F.size(page.texts))),
                lambda a, b: F.slice(page.texts, F.greatest(a, both.s.t0) + 1,
                                     F.greatest(F.least(b, both.s.t1) - F.greatest(a, both.s.t0), F.lit(0))))
            return F.array_join(F.flatten(gaps), " ")

        return let(F.struct(chosen.alias("s"), F.aggregate(cut, start, outer).alias("g")), texts)

    return F.trim(F.regexp_replace(let(noise, read), r"(?U)\s+", " "))


def generic_fields(page: Page) -> dict[str, Column]:
    """The generic pack: structured metadata over basic fields (F9), clean text."""
    basic, graph = basic_fields(page), open_graph(page)
    ld = json_ld(page)
    prefer = lambda a, b: F.coalesce(a, b)
    return {
        "title": prefer(graph["title"], F.when(ld.title.seen, ld.title.v).otherwise(basic["title"])),
        "author": ld.author.v,
        "description": graph["description"],
        "site_name": prefer(graph["site_name"], ld.site_name.v),
        "published_date": ld.published.v,
        "media_urls": F.array_distinct(basic["media_urls"]),
        "text": main_text(page),
        "selectors_used": basic["selectors_used"],
    }


def image_urls(page: Page, *, with_og: bool = True) -> Column:
    """C11: og:image, then absolute image sources, without repeats."""
    sources = F.filter(
        F.transform(F.filter(page.dom, lambda n: n.tag == "img"), lambda n: n.attrs.getItem("src")),
        lambda v: v.startswith("http"),
    )
    if with_og:
        head = F.filter(F.array(page.meta("og:image")), lambda v: v.isNotNull())
        sources = F.concat(head, sources)
    return F.array_distinct(sources)


def profile_stats(page: Page, family: str) -> Column:
    """struct(followers, following, posts) from list items; the last hit counts."""
    items = F.filter(page.dom, lambda n: n.tag == "li")
    start = F.struct(
        *[F.lit(None).cast("bigint").alias(n) for n in ("followers", "following", "posts")]
    )

    def step(acc: Column, item: Column) -> Column:
        low = F.lower(page.text(item, " "))
        span = F.get(page.inside(item, "span"), F.lit(0))
        value = parse_count(page.text(span), family)
        follower, following = low.contains("follower"), low.contains("following")
        return F.struct(
            F.when(follower, value).otherwise(acc.followers).alias("followers"),
            F.when(~follower & following, value).otherwise(acc.following).alias("following"),
            F.when(~follower & ~following & low.contains("post"), value)
            .otherwise(acc.posts).alias("posts"),
        )

    return F.aggregate(items, start, step)


def selector_snapshot(fields: dict[str, Column]) -> Column:
    """``map<field, struct(selector, matched, confidence)>`` of matched chains."""
    entries = [
        F.when(
            chain.isNotNull(),
            F.struct(
                F.lit(name).alias("key"),
                F.struct(
                    chain.selector.alias("selector"), F.lit(True).alias("matched"),
                    F.lit(1.0).alias("confidence"),
                ).alias("value"),
            ),
        )
        for name, chain in fields.items()
    ]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def completeness(fields: dict[str, Column], first_choice: dict[str, str]) -> tuple[Column, Column]:
    """(warnings, partial_reasons) of a set of chains."""
    warnings = [
        F.when(
            c.pos > 0,
            F.concat(F.lit("Used fallback selector "), c.selector,
                     F.lit(f" for {name} — primary selector may need updating.")),
        )
        for name, c in fields.items()
        if name in first_choice
    ]
    reasons = [
        F.when(
            c.isNull(),
            F.lit(f"{name}: no matching selectors found — site structure may have changed."),
        )
        for name, c in fields.items()
    ]
    keep = lambda a: F.filter(F.array(*a), lambda v: v.isNotNull())
    return keep(warnings), keep(reasons)


def next_page(page: Page, page_number: Column) -> Column:
    """struct(selector, href) of the link to the next page.

    A link showing the next number comes first, then the ordered "next" rules.
    Visibility, which needs a browser, is not looked at.
    """
    wanted = (page_number + 1).cast("string")
    links = F.filter(
        page.dom, lambda n: (n.tag == "a") & F.lower(page.text(n, " ")).contains(wanted)
    )
    numbered = let(
        F.get(links, F.lit(0)),
        lambda n: F.when(
            n.isNotNull(),
            F.struct(F.concat(F.lit('a:has-text("'), wanted, F.lit('")')).alias("selector"),
                     n.attrs.getItem("href").alias("href")),
        ),
    )

    def rule(selector: str) -> Column:
        def read(node: Column) -> Column:
            return F.when(
                node.isNotNull(),
                F.struct(F.lit(selector).alias("selector"), node.attrs.getItem("href").alias("href")),
            )

        return let(page.first(selector), read)

    return F.coalesce(numbered, *[rule(s) for s in NEXT_PAGE_SELECTORS])


def html_chunks(html: Column, max_tokens: int = CHUNK_TOKENS) -> Column:
    """Cut a page into pieces of at most ``4 * max_tokens`` characters.

    A piece ends before its last ``<`` when that lies past 80 % of the window.
    The whole page is covered; folding over a fixed number of steps suffices,
    because every piece but the last is longer than 80 % of the window.
    """
    size = max_tokens * 4
    # Fixed blocks first: a window lies in two of them, so no step reads the page from its start.
    blocks = F.regexp_extract_all(html, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    steps = F.sequence(F.lit(0), F.floor(F.length(html) / (size * 0.8)).cast("int") + 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("cuts"))

    def window(parts: Column, at: Column) -> Column:
        block, off = F.floor(at / size).cast("int"), (at % size).cast("int")
        both = F.concat(F.coalesce(F.get(parts, block), F.lit("")), F.coalesce(F.get(parts, block + 1), F.lit("")))
        return F.substring(both, off + 1, F.lit(size))

    def fold(bound: Column) -> Column:
        def step(acc: Column, _i: Column) -> Column:
            def cut(text: Column) -> Column:
                back = F.instr(F.reverse(text), "<")
                last = F.when(back > 0, F.length(text) - back).otherwise(-1)
                more = acc.at + size < bound.n
                width = F.when(more & (last > size * 0.8), last).otherwise(F.lit(size)).cast("int")
                return F.struct((acc.at + width).alias("at"), F.concat(acc.cuts, F.array(acc.at)).alias("cuts"))

            return F.when(acc.at >= bound.n, acc).otherwise(let(window(bound.blocks, acc.at), cut))

        cuts = F.aggregate(steps, start, step, lambda acc: F.concat(acc.cuts, F.array(bound.n)))

        def pieces(ends: Column) -> Column:
            spans = F.zip_with(F.slice(ends, F.lit(1), F.size(ends) - 1), F.slice(ends, F.lit(2), F.size(ends) - 1), lambda a, b: F.struct(a.alias("x"), b.alias("y")))
            return F.transform(spans, lambda s: F.substring(
                window(bound.blocks, s.getField("x")), F.lit(1), (s.getField("y") - s.getField("x")).cast("int")))

        return let(cuts, pieces)

    whole = F.struct(blocks.alias("blocks"), F.length(html).alias("n"))
    return F.when(F.length(html) <= size, F.array(html)).otherwise(let(whole, fold))


def explode_chunks(df: DataFrame, html: str = "html", max_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per piece: all other columns, ``chunk_no``, ``chunk``."""
    rest = [c for c in df.columns if c != html]
    return df.select(*rest, F.posexplode(html_chunks(F.col(html), max_tokens)).alias("chunk_no", "chunk"))
