"""HTML text to a queryable node table inside the row.

This is the only Python stage of the package.  It turns one page into

* ``dom``: nodes in document order; ``cls`` holds the class names between blanks,
  so that one ``contains`` tests for a class.  A node's id is its position, and its
  subtree is the id range ``(id, last]``, so "is inside" is two comparisons and
  the representation stays linear even for thousands of unclosed tags;
* ``texts``: the page's text pieces, trimmed and non-empty, in document order.
  ``[t0, t1)`` of a node delimits the pieces below it;
* ``skeleton``: tags and attribute names only, for structural fingerprints;
* ``parse_error``: why a page could not be read.  A bad page never fails a task.

Everything after it (selectors, field rules, gates) is Spark expressions over
these columns.  Tree rules: void elements close at once, an end tag closes the
nearest open element of its name and is otherwise ignored, nothing is closed by
implication, script/style/template/ruby strings are not part of a page's text.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from html import entities, unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, functions as F

from webgrain.functions.text import WHITE_SPACE

# Executors need not have this package installed: ship the reader itself.
register_pickle_by_value(sys.modules[__name__])

# --- fixed values -----------------------------------------------------------
VOID_TAGS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
# Strings below these tags are kept on the node itself, not in the page text.
CONTAINER_TAGS = frozenset(["script", "style", "template", "rt", "rp"])
SKELETON_SKIP = frozenset(["script", "style"])
# --- end of fixed values ----------------------------------------------------

# Elements whose content is raw text, text only, or too unusual for the plain reader.
RAW_TEXT_TAGS = frozenset(["script", "style"])
TEXT_ONLY_TAGS = frozenset(["title", "textarea"])
UNUSUAL_TAGS = frozenset(["xmp", "iframe", "noembed", "noframes", "plaintext"])

_BLANK = r"[ \t\n\r\f]"
_NAME = r"[a-zA-Z_][a-zA-Z0-9_:.-]*"
_QUOTED = r"""\"[^\"]*\"|'[^']*'|[^\s"'=<>`/]+(?=[ \t\n\r\f>])"""
_PLAIN_ATTR = re.compile(rf"{_BLANK}+({_NAME})(?:{_BLANK}*={_BLANK}*({_QUOTED}))?(?=[ \t\n\r\f/>])")
_ATTRS = rf"(?:{_BLANK}+{_NAME}(?:{_BLANK}*={_BLANK}*(?:{_QUOTED}))?(?=[ \t\n\r\f/>]))*{_BLANK}*"
_OTHER = r"""<!--(?:[^->]+(?:-[^->]+)*)?-->|<![dD][oO][cC][tT][yY][pP][eE] [^<>\[\]\"']*>"""
# Text up to a piece of markup, and that piece.
_PLAIN_TOKEN = re.compile(
    rf"([^<&]*+)(<[a-zA-Z][a-zA-Z0-9-]*{_ATTRS}/?>|</[a-zA-Z][a-zA-Z0-9-]*>|{_OTHER}|&(?:[a-zA-Z][a-zA-Z0-9]*|#[0-9]+);)"
)
_TAG_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9-]*")
_PLAIN_TEXT = re.compile(r"[^<&]*+")
_RAW_END = {t: re.compile(rf"</\s*{t}[^>]*>?", re.I) for t in RAW_TEXT_TAGS}
_TEXT_ONLY = re.compile(r"[^<]*</")
# From here on pages are read piece by piece.
_NOT_EVEN = re.compile(f"<(?:{'|'.join(sorted(RAW_TEXT_TAGS | TEXT_ONLY_TAGS | UNUSUAL_TAGS))})", re.I)
_OPEN, _VOID, _CLOSED, _CLOSE, _ENTITY, _GAP = range(6)


def _value(quoted: str | None) -> str | None:
    """Attribute value without its quotes, entities decoded."""
    if quoted is None:
        return None
    bare = quoted[1:-1] if quoted[0] in "\"'" else quoted
    return unescape(bare) if "&" in bare else bare


NODE_DDL = (
    "struct<id:int,parent:int,last:int,tag:string,attrs:map<string,string>,"
    "cls:string,t0:int,t1:int,raw:string>"
)
PAGE_DDL = f"struct<dom:array<{NODE_DDL}>,texts:array<string>,skeleton:string,parse_error:string>"

# Open tags whose reading is remembered; longer ones and more of them are read anew.
_KNOWN_TAGS, _KNOWN_LENGTH = 4_096, 256


def _node_parts(tag: str, attrs: list) -> tuple[str, list, list, str]:
    """Tag, names and values of its attributes, class names between blanks."""
    if not attrs:
        return tag, [], [], ""
    if len(attrs) == 1 and attrs[0][0] != "class":
        return tag, [attrs[0][0]], [attrs[0][1] or ""], ""
    named = {k: ("" if v is None else v) for k, v in attrs}
    classes = ""
    if "class" in named:
        named["class"] = " ".join(named["class"].split())
        classes = f" {named['class']} "
    return tag, list(named), list(named.values()), classes


class _PageReader(HTMLParser):
    """Reads one page after the other into the flat lists of the current batch."""

    def __init__(self, keep: frozenset[str] | None, skeleton: bool) -> None:
        super().__init__(convert_charrefs=False)
        self.keep = keep
        self.with_skeleton = skeleton
        self.known: dict[str, tuple] = {}
        self.shapes = _Shapes()
        self.start()

    def start(self) -> None:
        """Begin a batch: one list per leaf, ids and text numbers count from the page's first."""
        self.parents: list[int] = []
        self.lasts: list[int] = []
        self.tags: list[str] = []
        self.n_attrs: list[int] = []
        self.keys: list[str] = []
        self.values: list[str] = []
        self.classes: list[str] = []
        self.t0: list[int] = []
        self.t1: list[int] = []
        self.raws: list[str | None] = []
        self.texts: list[str] = []

    @property
    def nodes(self) -> list[list]:
        """Nodes of the last page: parent, last, tag, attrs, cls, t0, t1, raw."""
        ends = [sum(self.n_attrs[: i + 1]) for i in range(self.first_node, len(self.parents))]
        attrs = [list(zip(self.keys, self.values, strict=True))[e - self.n_attrs[i] : e] for i, e in enumerate(ends, self.first_node)]
        columns = [c[self.first_node :] for c in (self.parents, self.lasts, self.tags, self.classes, self.t0, self.t1, self.raws)]
        return [[*row[:3], a, *row[3:]] for a, *row in zip(attrs, *columns, strict=True)]

    def read(self, html: str) -> str | None:
        self.reset()
        self.first_node, self.first_text = len(self.parents), len(self.texts)
        self.bones: list[str] = ["[document][]("]
        self.stack: list[tuple[str, int, bool]] = []  # tag, node id, shows in the skeleton
        self.open_count: dict[str, int] = {}
        self.closed_voids: dict[str, int] = {}
        self.pending: list[str] = []
        self.containers: list[int] = []
        self.hidden = 0
        error = None
        try:
            done = self._read_plain(html)
            if done < len(html):
                self.feed(html[done:])
                self.close()
        except Exception as exc:  # noqa: BLE001 - a broken page must not fail the task
            error = f"{type(exc).__name__}: {exc}"
        self._flush()
        while self.stack:
            self._pop()
        self.bones.append(")")
        return error

    def _known(self, markup: str) -> tuple:
        """What a piece of plain markup does: kind, tag (or entity), names and values of attributes, classes."""
        parts = self.known.get(markup)
        if parts is not None:
            return parts
        first = markup[1]
        if markup[0] == "&":
            parts = (_ENTITY, markup[1:-1])
        elif first == "/":
            parts = (_CLOSE, markup[2:-1].lower())
        elif first == "!":
            parts = (_GAP, "")
        else:
            name = _TAG_NAME.match(markup, 1)
            tag, after_name = name[0].lower(), name.end()
            attrs = [] if after_name + 1 == len(markup) else [
                (k.lower(), _value(v or None)) for k, v in _PLAIN_ATTR.findall(markup, after_name)
            ]
            # No name or value ends in a slash here.
            kind = _CLOSED if markup[-2] == "/" else _VOID if tag in VOID_TAGS else _OPEN
            parts = (kind, *_node_parts(tag, attrs))
        if len(markup) <= _KNOWN_LENGTH:
            if len(self.known) >= _KNOWN_TAGS:
                self.known.clear()
            self.known[markup] = parts
        return parts

    def _read_even(self, html: str) -> int:
        """Read the page up to the first tag that changes how text is read, if all of that is well-formed.

        One call finds all pieces.  They join to the page exactly if nothing lies between them.
        """
        stop = _NOT_EVEN.search(html)
        limit = stop.start() if stop else len(html)
        pieces = _PLAIN_TOKEN.findall(html, 0, limit)
        whole = "".join([p for piece in pieces for p in piece])
        done = len(whole)
        if not html.startswith(whole) or html.find("<", done, limit) >= 0 or html.find("&", done, limit) >= 0:
            return 0
        pending, stack, containers, texts = self.pending, self.stack, self.containers, self.texts
        open_count, closed_voids, keep, known = self.open_count, self.closed_voids, self.keep, self.known
        parents, lasts, tags, n_attrs, keys, values = self.parents, self.lasts, self.tags, self.n_attrs, self.keys, self.values
        classes, t0, t1, raws, first_node, first_text = self.classes, self.t0, self.t1, self.raws, self.first_node, self.first_text
        for text, markup in pieces:
            if text:
                pending.append(text)
            parts = known.get(markup) or self._known(markup)
            kind, tag = parts[0], parts[1]
            if kind == _CLOSE:
                if closed_voids and closed_voids.get(tag):
                    closed_voids[tag] -= 1
                    continue
            elif kind == _ENTITY:
                if tag[0] == "#":
                    self.handle_charref(tag[1:])
                else:
                    self.handle_entityref(tag)
                continue
            if pending:
                if containers:
                    self._flush()
                else:
                    text = (pending[0] if len(pending) == 1 else "".join(pending)).strip()
                    pending.clear()
                    if text:
                        texts.append(text)
            if kind == _CLOSE:
                if open_count.get(tag):
                    below, upto, top = len(parents) - 1 - first_node, len(texts) - first_text, None
                    while top != tag:
                        top, node, _ = stack.pop()
                        open_count[top] -= 1
                        if keep is None or top in keep:
                            lasts[first_node + node] = below
                            t1[first_node + node] = upto
                        if top in CONTAINER_TAGS:
                            containers.pop()
                continue
            if kind == _GAP:
                continue
            parent = node = stack[-1][1] if stack else -1
            emitted = keep is None or tag in keep
            if emitted:
                node = len(parents) - first_node
                parents.append(parent)
                lasts.append(node)
                tags.append(tag)
                n_attrs.append(len(parts[2]))
                if parts[2]:
                    keys += parts[2]
                    values += parts[3]
                classes.append(parts[4])
                number = len(texts) - first_text
                t0.append(number)
                t1.append(number)
                raws.append(None)
            if kind == _OPEN:
                stack.append((tag, node, False))
                open_count[tag] = open_count.get(tag, 0) + 1
                if tag in CONTAINER_TAGS:
                    containers.append(node if emitted else -1)
            elif kind == _VOID:
                closed_voids[tag] = closed_voids.get(tag, 0) + 1
        if done < limit:
            pending.append(html[done:limit])
        return limit

    def _read_plain(self, html: str) -> int:
        """Read well-formed markup up to the first construct that is not.

        One regular expression per token is several times faster than the
        tolerant parser, which takes over from the returned position.
        """
        at, match = 0 if self.with_skeleton else self._read_even(html), _PLAIN_TOKEN.match
        while at < len(html):
            token = match(html, at)
            if token is None:
                last = _PLAIN_TEXT.match(html, at)[0]
                if last:
                    self.pending.append(last)
                return at + len(last)
            text, markup = token.groups()
            end = token.end()
            if text:
                self.pending.append(text)
            kind, tag, *parts = self._known(markup)
            if kind == _ENTITY:
                if tag[0] == "#":
                    self.handle_charref(tag[1:])
                else:
                    self.handle_entityref(tag)
            elif kind == _CLOSE:
                self.handle_endtag(tag)
            elif kind == _GAP:
                self._flush()
            elif tag in UNUSUAL_TAGS:
                return end - len(markup)
            elif kind == _CLOSED:
                self._push(tag, *parts)
                self._end(tag)
            elif tag in RAW_TEXT_TAGS:
                # Raw text runs to its own plain end tag, or is left to the tolerant parser.
                stop = _RAW_END[tag].search(html, end)
                if stop is None or stop.group().lower() != f"</{tag}>":
                    return end - len(markup)
                self._push(tag, *parts)
                if stop.start() > end:
                    self.pending.append(html[end : stop.start()])
                self.handle_endtag(tag)
                end = stop.end()
            elif tag in TEXT_ONLY_TAGS and not _TEXT_ONLY.match(html, end):
                return end - len(markup)
            else:
                self._push(tag, *parts)
                if kind == _VOID:
                    self._close_void(tag)
            at = end
        return at

    def _flush(self) -> None:
        pending = self.pending
        if not pending:
            return
        text = pending[0] if len(pending) == 1 else "".join(pending)
        pending.clear()
        if self.containers:
            node = self.containers[-1]
            if node >= 0:
                at = self.first_node + node
                self.raws[at] = (self.raws[at] or "") + text
            return
        text = text.strip()
        if text:
            self.texts.append(text)

    def _push(self, tag: str, keys: list, values: list, classes: str) -> None:
        self._flush()
        parent = self.stack[-1][1] if self.stack else -1
        emitted = self.keep is None or tag in self.keep
        node = parent
        if emitted:
            node = len(self.parents) - self.first_node
            start = len(self.texts) - self.first_text
            self.parents.append(parent)
            self.lasts.append(node)
            self.tags.append(tag)
            self.n_attrs.append(len(keys))
            self.keys += keys
            self.values += values
            self.classes.append(classes)
            self.t0.append(start)
            self.t1.append(start)
            self.raws.append(None)
        shown = False
        if tag in SKELETON_SKIP:
            self.hidden += 1
        elif self.with_skeleton and not self.hidden:
            shown = True
            names = sorted(k for k in keys if k != "id")
            self.bones.append(f"{tag}[{','.join(names)}](")
        if tag in CONTAINER_TAGS:
            self.containers.append(node if emitted else -1)
        self.stack.append((tag, node, shown))
        self.open_count[tag] = self.open_count.get(tag, 0) + 1

    def _pop(self) -> str:
        tag, node, shown = self.stack.pop()
        self.open_count[tag] -= 1
        if self.keep is None or tag in self.keep:
            at = self.first_node + node
            self.lasts[at] = len(self.parents) - 1 - self.first_node
            self.t1[at] = len(self.texts) - self.first_text
        if shown:
            self.bones.append(")")
        if tag in SKELETON_SKIP:
            self.hidden -= 1
        if tag in CONTAINER_TAGS:
            self.containers.pop()
        return tag

    def _end(self, tag: str) -> None:
        self._flush()
        if self.open_count.get(tag):
            while self._pop() != tag:
                pass

    def _close_void(self, tag: str) -> None:
        self._end(tag)
        self.closed_voids[tag] = self.closed_voids.get(tag, 0) + 1

    def handle_starttag(self, tag, attrs):
        self._push(*_node_parts(tag, attrs))
        if tag in VOID_TAGS:
            self._close_void(tag)

    def handle_startendtag(self, tag, attrs):
        self._push(*_node_parts(tag, attrs))
        self._end(tag)

    def handle_endtag(self, tag):
        if self.closed_voids.get(tag):
            self.closed_voids[tag] -= 1
        else:
            self._end(tag)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_charref(self, name):
        self.pending.append(unescape(f"&#{name};"))

    def handle_entityref(self, name):
        self.pending.append(entities.html5.get(f"{name};", f"&{name}"))

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self.pending.append(data[6:])
            self._flush()

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()


# The same for the pieces of a page between its "<": up to the first ">" and after it.
_WHOLE_TAG = re.compile(rf"(?:[a-zA-Z][a-zA-Z0-9-]*{_ATTRS}/?|/[a-zA-Z][a-zA-Z0-9-]*)>")
_WHOLE_OTHER = re.compile(_OTHER)
_PLAIN_ENTITY = re.compile(r"&(?:([a-zA-Z][a-zA-Z0-9]*)|#([0-9]+));")
# Pages with one of these are read one by one: their text is not all page text.
_NOT_TOGETHER = f"<(?:{'|'.join(sorted(CONTAINER_TAGS | RAW_TEXT_TAGS | TEXT_ONLY_TAGS | UNUSUAL_TAGS))})"
_BAD = 6  # a piece that is not plain markup
_KNOWN_SHAPES = 1_024
_TOGETHER = 1_000_000


def _entity(found: re.Match) -> str:
    name, number = found.groups()
    return unescape(f"&#{number};") if name is None else entities.html5.get(f"{name};", f"&{name}")


class _Shapes:
    """What tags say, learned once for each tag and its attributes' names; the values are cut out."""

    def __init__(self) -> None:
        self.pieces: dict[str, tuple[int, list | None, str]] = {}
        self.clear()

    def clear(self) -> None:
        self.pieces.clear()
        self.of: dict[str, tuple[int, int | None]] = {}
        self.kinds: list[int] = []
        self.tags: list[str] = []
        self.names: list[list[str]] = []

    def _add(self, kind: int, tag: str, names: list[str]) -> int:
        self.kinds.append(kind)
        self.tags.append(tag)
        self.names.append(names)
        return len(self.kinds) - 1

    def learn(self, tags: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray, pa.Array]:
        """For each of the tags the number of its shape and the place of its first value, and all values;
        the place of its class names, and all class names between blanks.
        """
        at, cut = _cut(tags, '"')
        cuts = np.diff(at)
        quoted = (np.arange(len(cut)) - np.repeat(at[:-1], cuts)) % 2 == 1
        around = pa.ListArray.from_arrays(_offsets((cuts + 1) // 2), cut.filter(pa.array(~quoted)))
        outer = pc.binary_join(around, '""').dictionary_encode()
        found = [self._of(o) for o in outer.dictionary.to_pylist()]
        of = outer.indices.to_numpy()
        number = np.array([n for n, _ in found], np.int64)[of]
        class_at = np.array([-2 if place is None else place for _, place in found], np.int64)[of]
        class_at[cuts % 2 == 0] = -2  # a quote that does not end
        values = cut.filter(pa.array(quoted))
        values = _changed(values, pc.match_substring(values, "&"), unescape)
        starts = np.cumsum(cuts // 2) - cuts // 2
        # Class names, each different value once.
        named = np.flatnonzero(class_at >= 0)
        places = starts[named] + class_at[named]
        own = values.take(pa.array(places)).dictionary_encode()
        tidy = [" ".join(v.split()) for v in own.dictionary.to_pylist()]
        if tidy != own.dictionary.to_pylist():
            is_class = np.zeros(len(values), bool)
            is_class[places] = True
            values = pc.replace_with_mask(values, pa.array(is_class), pa.array(tidy, pa.string()).take(own.indices))
        classes = ["", *[f" {v} " for v in tidy]]
        class_of = np.zeros(len(tags), np.int64)
        class_of[named] = own.indices.to_numpy() + 1
        # Tags with values that are not all between double quotes, and what is no tag.
        more: list[str] = []
        odd = np.flatnonzero(class_at == -2)
        for i, piece in zip(odd.tolist(), tags.take(pa.array(odd)).to_pylist(), strict=True):
            number[i], others, names = self.pieces.get(piece) or self._odd(piece)
            starts[i], class_of[i] = len(values) + len(more), len(classes)
            more += others or []
            classes.append(names)
        if more:
            values = pa.concat_arrays([values, pa.array(more, pa.string())])
        return number, starts, values, class_of, pa.array(classes, pa.string())

    def _of(self, outer: str) -> tuple[int, int | None]:
        known = self.of.get(outer)
        if known is None:
            known = self.of[outer] = self._shape(outer)
        return known

    def _odd(self, piece: str) -> tuple[int, list | None, str]:
        kind, tag, names, values, classes = self._whole(piece)
        out = self._add(kind, tag, names), values, classes
        if len(piece) <= _KNOWN_LENGTH:
            if len(self.pieces) >= _KNOWN_TAGS:
                self.pieces.clear()
            self.pieces[piece] = out
        return out

    def _shape(self, outer: str) -> tuple[int, int | None]:
        """Number and place of the class; no place where a value is not between double quotes or a name repeats."""
        if "'" not in outer and _WHOLE_TAG.fullmatch(f"{outer}>"):
            kind, tag, names, values, _ = self._whole(outer)
            if not names or (outer.count("=") == len(names) == outer.count('"') // 2 and not any(values)):
                return self._add(kind, tag, names), names.index("class") if "class" in names else -1
        return -1, None

    def _whole(self, piece: str) -> tuple[int, str, list, list | None, str]:
        if not _WHOLE_TAG.fullmatch(f"{piece}>"):
            return (_GAP if _WHOLE_OTHER.fullmatch(f"<{piece}>") else _BAD), "", [], None, ""
        if piece[0] == "/":
            return _CLOSE, piece[1:].lower(), [], None, ""
        name = _TAG_NAME.match(piece)
        tag = name[0].lower()
        attrs = [(k.lower(), _value(v or None)) for k, v in _PLAIN_ATTR.findall(f"{piece}>", name.end())]
        return (_CLOSED if piece[-1] == "/" else _VOID if tag in VOID_TAGS else _OPEN), *_node_parts(tag, attrs)


def _cut(texts: pa.Array, mark: str, most: int | None = None) -> tuple[np.ndarray, pa.Array]:
    """The pieces of all texts in one array, and where those of each text begin (and the last ones end)."""
    cut = pc.split_pattern(texts, mark, max_splits=most)
    return np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy(), dtype=np.int64)]), cut.flatten()


def _changed(texts: pa.Array, some: pa.Array, change: Callable[[str], str]) -> pa.Array:
    """The texts, some of them changed."""
    if not pc.any(some).as_py():
        return texts
    return pc.replace_with_mask(texts, some, pa.array([change(t) for t in texts.filter(some).to_pylist()], pa.string()))


def _plain_entities(text: str) -> bool:
    return text.count("&") == len(_PLAIN_ENTITY.findall(text))


def _read_together(shapes: _Shapes, pages: pa.Array | list[str]) -> tuple[np.ndarray, pa.StructArray | None]:
    """Read pages of plain markup whose tags all close in order, many at once.

    Which pages are not like that; and all pages, if there is none.  No tree is walked: the level of a
    tag is a running sum, and a tag and its end tag are neighbours among the tags of their level.
    Arrow cuts the texts; Python sees each different tag's shape, each different class and what has entities.
    """
    if len(shapes.kinds) >= _KNOWN_SHAPES:
        shapes.clear()
    if not isinstance(pages, pa.Array):
        pages = pa.array(pages, pa.string())
    page_at, pieces = _cut(pc.binary_join_element_wise(">", pages, ""), "<")
    piece_at, parts = _cut(pieces, ">", 1)
    heads = parts.take(pa.array(piece_at[:-1])).dictionary_encode()
    head = heads.indices.to_numpy()
    number, value_at, values, class_of, classes = shapes.learn(heads.dictionary)
    tails = parts.take(pa.array(piece_at[1:] - 1))
    odd = np.diff(piece_at) == 1
    if pc.any(pc.match_substring(tails, "&")).as_py():
        coded = np.flatnonzero(pc.match_substring(tails, "&").to_numpy(zero_copy_only=False))
        plain = [_plain_entities(t) for t in tails.take(pa.array(coded)).to_pylist()]
        odd[coded[~np.array(plain)]] = True
        tails = _changed(tails, pc.match_substring(tails, "&"), lambda t: _PLAIN_ENTITY.sub(_entity, t))
    tails = pc.utf8_trim(tails, characters=WHITE_SPACE)
    firsts, n_pieces = page_at[:-1], np.diff(page_at)
    page = np.repeat(np.arange(len(pages)), n_pieces)
    shape = number[head]
    kind = np.array(shapes.kinds, np.int8)[shape]
    kind[firsts] = _GAP
    kind[odd] = _BAD
    step = (kind == _OPEN).astype(np.int64) - (kind == _CLOSE)
    level = np.cumsum(step)
    level -= np.repeat(level[firsts] - step[firsts], n_pieces)
    bad = np.zeros(len(pages), bool)
    bad[page[(kind == _BAD) | (level < 0)]] = True
    bad |= level[firsts + n_pieces - 1] != 0
    # Tags and end tags by level; in order, they come in pairs.
    own = level + (kind == _CLOSE) + ((kind == _VOID) | (kind == _CLOSED))
    paired = np.flatnonzero((step != 0) & ~bad[page])
    paired = paired[np.argsort(own[paired], kind="stable")]
    opens, closes = paired[::2], paired[1::2]
    number_of: dict[str, int] = {}
    tag = np.array([number_of.setdefault(t, len(number_of)) for t in shapes.tags], np.int64)[shape]
    bad[page[opens[tag[opens] != tag[closes]]]] = True
    if bad.any():
        return bad, None
    is_node = (kind == _OPEN) | (kind == _VOID) | (kind == _CLOSED)
    at = np.flatnonzero(is_node)
    before = np.cumsum(is_node) - is_node  # nodes before a piece
    first_node = before[firsts]
    filled = pc.binary_length(tails).to_numpy() > 0
    texts = np.cumsum(filled) - filled  # texts before a piece's own
    first_text = texts[firsts]
    n_nodes = np.bincount(page[at], minlength=len(pages))
    n_texts = np.bincount(page[filled], minlength=len(pages))
    ends = np.full(len(pieces), -1)
    ends[opens] = closes
    end, mine = ends[at], page[at]
    last = np.where(end < 0, before[at], before[end] - 1) - first_node[mine]
    # ``opens`` stand by level and place: the parent is the last one before on the level above.
    span = len(pieces) + 1
    above = np.searchsorted(own[opens] * span + opens, (own[at] - 1) * span + at) - 1
    inner = own[at] > 1
    parent = np.where(inner, before[opens[above]] - first_node[mine], -1) if len(opens) else np.full(len(at), -1)
    n_names = np.array([len(n) for n in shapes.names], np.int64)
    name_at = np.cumsum(n_names) - n_names
    n_attrs = n_names[shape[at]]
    starts = np.cumsum(n_attrs) - n_attrs
    within = np.arange(n_attrs.sum()) - np.repeat(starts, n_attrs)
    names = np.repeat(name_at[shape[at]], n_attrs) + within
    said = np.repeat(value_at[head[at]], n_attrs) + within
    int32 = lambda x: pa.array(x.astype(np.int32))
    nodes = _nodes([
        int32(before[at] - first_node[mine]), int32(parent), int32(last), pa.array(shapes.tags, pa.string()).take(pa.array(shape[at])),
        pa.MapArray.from_arrays(
            _offsets(n_attrs), pa.array([n for own in shapes.names for n in own], pa.string()).take(pa.array(names)),
            values.take(pa.array(said)),
        ),
        classes.take(pa.array(class_of[head[at]])), int32(texts[at] - first_text[mine]),
        int32(np.where(end < 0, texts[at], texts[end]) - first_text[mine]), pa.nulls(len(at), pa.string()),
    ])
    nothing = pa.nulls(len(pages), pa.string())
    return bad, _pages(n_nodes, nodes, n_texts, tails.filter(pa.array(filled)), nothing, nothing)


def _offsets(sizes: list[int] | np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), pa.int32())


def _nodes(leaves: list[pa.Array]) -> pa.StructArray:
    return pa.StructArray.from_arrays(leaves, names=["id", "parent", "last", "tag", "attrs", "cls", "t0", "t1", "raw"])


def _pages(
    n_nodes: list[int] | np.ndarray, nodes: pa.StructArray, n_texts: list[int] | np.ndarray, texts: pa.Array,
    skeletons: pa.Array, errors: pa.Array,
) -> pa.StructArray:
    return pa.StructArray.from_arrays(
        [
            pa.ListArray.from_arrays(_offsets(n_nodes), nodes),
            pa.ListArray.from_arrays(_offsets(n_texts), texts),
            skeletons, errors,
        ],
        names=["dom", "texts", "skeleton", "parse_error"],
    )


def _read_batch(reader: _PageReader, pages: pa.Array, skeleton: bool) -> pa.StructArray:
    """Plain pages many at once, as many as have ``_TOGETHER`` characters; the others one by one."""
    pages = pc.fill_null(pages, "")
    if skeleton or reader.keep is not None:
        return _read_each(reader, pages.to_pylist(), skeleton)
    groups, size = [0], 0
    for i, length in enumerate(pc.utf8_length(pages).to_pylist()):
        if size + length > _TOGETHER and i > groups[-1]:
            groups.append(i)
            size = 0
        size += length
    ends = [*groups[1:], len(pages)]
    read = [_read_group(reader, pages.slice(i, end - i)) for i, end in zip(groups, ends, strict=True)]
    return read[0] if len(read) == 1 else pa.concat_arrays(read)


def _read_group(reader: _PageReader, whole: pa.Array) -> pa.StructArray:
    even = np.flatnonzero(~pc.match_substring_regex(whole, _NOT_TOGETHER, ignore_case=True).to_numpy(zero_copy_only=False))
    together = None
    if len(even):
        bad, together = _read_together(reader.shapes, whole.take(pa.array(even)))
        if together is None:
            even = even[~bad]
            if len(even):
                _, together = _read_together(reader.shapes, whole.take(pa.array(even)))
    if len(even) == len(whole) and together is not None:
        return together
    rest = np.setdiff1d(np.arange(len(whole)), even)
    each = _read_each(reader, whole.take(pa.array(rest)).to_pylist(), False)
    if not len(even):
        return each
    places = np.empty(len(whole), np.int64)
    places[np.concatenate([even, rest])] = np.arange(len(whole))
    return pa.concat_arrays([together, each]).take(pa.array(places))


def _read_each(reader: _PageReader, pages: list[str], skeleton: bool) -> pa.StructArray:
    """Columnar build: one flat list per leaf, offsets for the nesting."""
    n_nodes, n_texts = [], []
    bones: list[str | None] = []
    errors: list[str | None] = []
    reader.start()
    for html in pages:
        errors.append(reader.read(html))
        n_nodes.append(len(reader.parents) - reader.first_node)
        n_texts.append(len(reader.texts) - reader.first_text)
        bones.append("".join(reader.bones) if skeleton else None)
    starts = np.cumsum(n_nodes, dtype=np.int64) - n_nodes
    ids = np.arange(len(reader.parents)) - np.repeat(starts, n_nodes)
    attr_maps = pa.MapArray.from_arrays(
        _offsets(reader.n_attrs), pa.array(reader.keys, pa.string()), pa.array(reader.values, pa.string())
    )
    nodes = _nodes([
        pa.array(ids, pa.int32()), pa.array(reader.parents, pa.int32()), pa.array(reader.lasts, pa.int32()),
        pa.array(reader.tags, pa.string()), attr_maps, pa.array(reader.classes, pa.string()),
        pa.array(reader.t0, pa.int32()), pa.array(reader.t1, pa.int32()), pa.array(reader.raws, pa.string()),
    ])
    texts = pa.array(reader.texts, pa.string())
    return _pages(n_nodes, nodes, n_texts, texts, pa.array(bones, pa.string()), pa.array(errors, pa.string()))


def parse_page(html: Column, *, keep_tags: list[str] | None = None, skeleton: bool = False) -> Column:
    """Parse a page once.  Only ``html`` crosses to Python; other columns do not.

    ``keep_tags`` drops all other nodes at the source (their text stays), which
    keeps the node table small when the caller's selectors name few tags.
    Evaluate it in its own ``withColumn`` and read fields from the result.
    """
    keep = frozenset(keep_tags) if keep_tags is not None else None

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = _PageReader(keep, skeleton)
        for batch in batches:
            yield _read_batch(reader, batch, skeleton)

    read.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Marked as non-deterministic so that the optimizer never copies the parse
    # into a pushed-down filter or into two projections.
    return F.arrow_udf(read, PAGE_DDL).asNondeterministic()(html)
