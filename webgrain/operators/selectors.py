"""CSS-style selectors as Spark SQL expressions over the node table.

Supported: tag, ``.class``, ``[attr]``, ``[attr=v]``, ``[attr*=v]``,
``[attr^=v]``, ``:has-text("v")``, descendant and child combinators, comma
lists.  Every step of a chain is one filter over ``dom``; the matches of the
step before are bound once, so a chain costs (steps x nodes).

The rules are written as SQL text: a page type has dozens of selectors, and one
parsed string per chain keeps the job's planning short.
"""

from __future__ import annotations

import itertools
import re
from functools import reduce
from operator import and_, or_
from os.path import commonprefix

from pyspark.sql import Column, functions as F

from webgrain.functions.text import strip

_PIECE = re.compile(
    r"""(?P<tag>^[a-zA-Z][\w-]*|^\*)|\.(?P<cls>[\w-]+)"""
    r"""|\[(?P<attr>[\w:-]+)(?:(?P<op>[*^]?=)(?P<q>["']?)(?P<val>.*?)(?P=q))?\]"""
    r"""|:has-text\("(?P<text>.*?)"\)"""
)
_STEP = re.compile(r"""((?:\[[^\]]*\]|\([^)]*\)|[^\s>\[(])+)|(>)""")
_OWN_TEXT_TAGS = "('script', 'style', 'template', 'rt', 'rp')"
_names = itertools.count()


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _var(prefix: str) -> str:
    return f"{prefix}{next(_names)}"


class Page:
    """One parsed page (a column name or a struct field path), with look-ups on top."""

    def __init__(self, parsed: str = "parsed", url: Column | None = None) -> None:
        self.sql = parsed
        self.dom = F.col(f"{parsed}.dom")
        self.texts = F.col(f"{parsed}.texts")
        self.url = url

    # --- SQL fragments --------------------------------------------------------
    def _fits(self, compound: str, n: str) -> str:
        """Condition for one compound selector such as ``article.post[data-id]``."""
        pieces = list(_PIECE.finditer(compound))
        if "".join(p.group(0) for p in pieces) != compound or not pieces:
            raise ValueError(f"unsupported selector: {compound}")
        tests = []
        for p in pieces:
            value = f"{n}.attrs[{quoted((p['attr'] or '').lower())}]"
            if p["tag"]:
                if p["tag"] != "*":
                    tests.append(f"{n}.tag = {quoted(p['tag'].lower())}")
            elif p["cls"]:
                tests.append(f"contains({n}.cls, {quoted(' ' + p['cls'] + ' ')})")
            elif p["text"] is not None:
                tests.append(f"contains(lower({self._text(n, ' ')}), {quoted(p['text'].lower())})")
            elif p["op"] is None:
                tests.append(f"{value} IS NOT NULL")
            elif p["op"] == "=":
                tests.append(f"coalesce({value} = {quoted(p['val'])}, false)")
            else:
                test = "contains" if p["op"] == "*=" else "startswith"
                tests.append(f"coalesce({test}({value}, {quoted(p['val'])}), false)")
        return " AND ".join(tests) or "true"

    def _chain(self, selector: str) -> str:
        """All nodes of one comma-free selector, in document order."""
        steps = [m.group(0) for m in _STEP.finditer(selector.strip())]
        n = _var("n")
        found = f"filter({self.sql}.dom, {n} -> {self._fits(steps[0], n)})"
        child = False
        for step in steps[1:]:
            if step == ">":
                child = True
                continue
            up, n, a = _var("u"), _var("n"), _var("a")
            related = f"{a}.id = {n}.parent" if child else f"{a}.id < {n}.id AND {n}.id <= {a}.last"
            spans = f"transform({found}, {a} -> named_struct('id', {a}.id, 'last', {a}.last))"
            found = (
                f"get(transform(array({spans}), {up} -> filter({self.sql}.dom, {n} -> "
                f"{self._fits(step, n)} AND exists({up}, {a} -> {related}))), 0)"
            )
            child = False
        return found

    def _select(self, selector: str) -> str:
        """All matching nodes in document order; a comma list is a union."""
        parts = [p.strip() for p in selector.split(",")]
        if len(parts) == 1:
            return self._chain(parts[0])
        n = _var("n")
        if all(re.fullmatch(r"[^\s>]+", p) for p in parts):
            tests = " OR ".join(f"({self._fits(p, n)})" for p in parts)
            return f"filter({self.sql}.dom, {n} -> {tests})"
        hits, a = _var("h"), _var("a")
        ids = ", ".join(f"transform({self._chain(p)}, {a} -> {a}.id)" for p in parts)
        return (
            f"get(transform(array(concat({ids})), {hits} -> "
            f"filter({self.sql}.dom, {n} -> array_contains({hits}, {n}.id))), 0)"
        )

    def _first(self, selector: str) -> str:
        """Zero or one node, as an array."""
        return f"slice({self._select(selector)}, 1, 1)"

    def _text(self, n: str, separator: str = "") -> str:
        return (
            f"CASE WHEN {n}.tag IN {_OWN_TEXT_TAGS} THEN coalesce(trim({n}.raw), '') ELSE "
            f"array_join(slice({self.sql}.texts, {n}.t0 + 1, {n}.t1 - {n}.t0), {quoted(separator)}) END"
        )

    # --- nodes ------------------------------------------------------------------
    def select(self, selector: str) -> Column:
        return F.expr(self._select(selector))

    def first(self, selector: str) -> Column:
        return F.expr(f"get({self._select(selector)}, 0)")

    def inside(self, scope: Column, selector: str) -> Column:
        """Matching nodes below ``scope``, for compound selectors and comma lists of them.

        Ids are positions and a subtree is a range of them, so only the subtree is looked at.
        """
        below = F.slice(self.dom, scope.id + 2, scope.last - scope.id)
        parts = [p.strip() for p in selector.split(",")]
        return F.filter(below, lambda node: reduce(or_, [self._matches(p, node) for p in parts]))

    def _matches(self, compound: str, node: Column) -> Column:
        """``_fits`` for a node that is a column."""
        tests = [F.lit(True)]
        for p in _PIECE.finditer(compound):
            value = node.attrs.getItem((p["attr"] or "").lower())
            if p["tag"]:
                tests += [node.tag == p["tag"].lower()] if p["tag"] != "*" else []
            elif p["cls"]:
                tests.append(node.cls.contains(f" {p['cls']} "))
            elif p["text"] is not None:
                tests.append(F.lower(self.text(node, " ")).contains(p["text"].lower()))
            elif p["op"] is None:
                tests.append(value.isNotNull())
            else:
                test = {"=": value == p["val"], "*=": value.contains(p["val"] or ""), "^=": value.startswith(p["val"] or "")}[p["op"]]
                tests.append(F.coalesce(test, F.lit(False)))
        return reduce(and_, tests)

    # --- values of nodes ----------------------------------------------------------
    def text(self, node: Column, separator: str = "") -> Column:
        """Text below a node; the pieces are trimmed and joined by ``separator``."""
        own = F.slice(self.texts, node.t0 + 1, node.t1 - node.t0)
        return F.when(
            node.isNotNull(),
            F.when(
                node.tag.isin("script", "style", "template", "rt", "rp"),
                F.coalesce(strip(node.raw), F.lit("")),
            ).otherwise(F.array_join(own, separator)),
        )

    def first_text(self, selector: str, separator: str = "") -> Column:
        """Text of the first match, NULL without one."""
        n = _var("n")
        return F.expr(
            f"get(transform({self._first(selector)}, {n} -> {self._text(n, separator)}), 0)"
        )

    def first_texts(self, classes: list[str], separator: str = "") -> Column:
        """For each class name, text of the first node that has it, NULL without one.

        All nodes are passed once: those with a class that begins as all the names do are looked at further.
        """
        n, hits = _var("n"), _var("h")
        begin = quoted(" " + commonprefix(classes))
        found = [f"get(filter({hits}, {n} -> {self._fits('.' + name, n)}), 0)" for name in classes]
        return F.expr(
            f"get(transform(array(filter({self.sql}.dom, {n} -> contains({n}.cls, {begin}))), {hits} -> "
            f"transform(array({', '.join(found)}), {n} -> {self._text(n, separator)})), 0)"
        )

    def first_attr(self, selector: str, name: str) -> Column:
        """Attribute of the first match."""
        n = _var("n")
        return F.expr(
            f"get(transform({self._first(selector)}, {n} -> {n}.attrs[{quoted(name)}]), 0)"
        )

    def all_text(self) -> Column:
        """Visible text of the whole page."""
        return F.array_join(self.texts, " ")

    def texts_of(self, selector: str, *, keep_empty: bool = False) -> Column:
        """Texts of all matches."""
        n, v = _var("n"), _var("v")
        values = f"transform({self._select(selector)}, {n} -> {self._text(n)})"
        return F.expr(values if keep_empty else f"filter({values}, {v} -> {v} <> '')")

    def attrs_of(self, selector: str, name: str) -> Column:
        """Non-empty attribute values of all matches."""
        n, v = _var("n"), _var("v")
        values = f"transform({self._select(selector)}, {n} -> {n}.attrs[{quoted(name)}])"
        return F.expr(f"filter({values}, {v} -> {v} <> '')")

    def values_of(self, selector: str) -> Column:
        """``sel``, ``sel::text`` (texts, empty ones too) or ``sel::attr(x)``."""
        attr = re.search(r"::attr\(([^)]+)\)$", selector)
        if attr:
            return self.attrs_of(selector[: attr.start()], attr.group(1))
        return self.texts_of(selector.removesuffix("::text"), keep_empty=True)

    def meta(self, prop: str) -> Column:
        """Trimmed content of the first meta tag with this property, NULL when empty."""
        content = self.first_attr(f"meta[property='{prop}']", "content")
        return F.when(content != "", strip(content))

    # --- chains ---------------------------------------------------------------------
    def chain(self, selectors: list[str]) -> Column:
        """First selector of the chain with a match.

        struct(value, stamp, href, selector, pos): ``value`` is the text of the
        first matching element (possibly empty), ``stamp`` its C22 reading (the
        ``datetime`` of a <time> element, else the text, NULL when blank),
        ``href`` its link target.  NULL when nothing matches.
        """
        steps = []
        for pos, selector in enumerate(selectors):
            n = _var("n")
            text = self._text(n)
            stamp = (
                f"nullif(CASE WHEN {n}.tag = 'time' THEN trim(coalesce({n}.attrs['datetime'], '')) "
                f"ELSE {text} END, '')"
            )
            steps.append(
                f"get(transform({self._first(selector)}, {n} -> named_struct('value', {text}, "
                f"'stamp', {stamp}, 'href', {n}.attrs['href'], "
                f"'selector', {quoted(selector)}, 'pos', {pos})), 0)"
            )
        return F.expr(f"coalesce({', '.join(steps)})")

    def attr_chain(self, pairs: list[tuple[str, str]], *, non_empty: bool) -> Column:
        """First (selector, attribute) whose first element has the attribute.

        struct(value, selector); with ``non_empty`` a blank value does not count.
        """
        steps = []
        for selector, name in pairs:
            n = _var("n")
            value = f"{n}.attrs[{quoted(name)}]"
            counts = f"{value} <> ''" if non_empty else f"{value} IS NOT NULL"
            steps.append(
                f"get(transform(filter({self._first(selector)}, {n} -> {counts}), {n} -> "
                f"named_struct('value', {value}, 'selector', {quoted(selector)})), 0)"
            )
        return F.expr(f"coalesce({', '.join(steps)})")


def tags_named(selectors: list[str]) -> list[str] | None:
    """Tags that the selectors touch, or NULL when one of their steps names no tag.

    Feeds ``parse_page(keep_tags=...)``.
    """
    tags: set[str] = set()
    for selector in selectors:
        for part in selector.split(","):
            for step in (m.group(0) for m in _STEP.finditer(part.strip())):
                if step == ">":
                    return None
                tag = re.match(r"[a-zA-Z][\w-]*", step)
                if tag is None:
                    return None
                tags.add(tag.group(0).lower())
    return sorted(tags)
