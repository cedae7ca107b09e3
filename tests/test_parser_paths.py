"""The plain reader and the tolerant parser must agree on any input."""

import sys

import pyarrow as pa
import pytest
from hypothesis import example, given, settings, strategies as st

from webgrain.operators import dom
from webgrain.operators.dom import _PageReader

PIECES = st.sampled_from([
    "<p>", "</p>", "<b class='a  b'>", "</b>", "<br>", "<br/>", "</br>", "<img src=x alt=\"q>r\">", "<IMG SRC = 'x&amp;y' data-x>",
    "text", " ", "&amp;", "&nosuch;", "&copy", "&#65;", "&#x41;", "&", "a & b", "<", ">", "<!-- c -->", "<!---->", "<!-- a--b -->",
    "<!DOCTYPE html>", "<![CDATA[x]]>", "<?pi?>", "<script>if (a<b) {}</script>", "<script>", "</script>", "</script >",
    "<style>p{}</style>", "<script></script>", "<style></style>", "<title>t &lt; u</title>", "<title><b>x</b></title>", "<div/>", "<a href=x/>", "<a href=\"x\"class=y>",
    "<p\xa0x>", "<p a=\xa0>", "<p a a=2 A=3>", "</ p>", "</p x>", "<5>", "</>", "<x-y z:w=1 _q>", "<textarea><i></textarea>",
    "<iframe>&amp;</iframe>", "\n", "é",
])


def outcome(reader, html):
    error = reader.read(html)
    return error, reader.nodes, reader.texts, reader.bones


class Tolerant(_PageReader):
    def _read_plain(self, html):
        return 0


@settings(max_examples=1500, deadline=None)
@example("<script></script>")
@example("<p>a<style></style>b</p>")
@given(st.lists(PIECES, max_size=14).map("".join))
def test_paths_agree(html):
    assert outcome(_PageReader(None, True), html) == outcome(Tolerant(None, True), html)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="<>/ab=\"'&;!- \n#1", max_size=30))
def test_paths_agree_on_noise(html):
    assert outcome(_PageReader(None, True), html) == outcome(Tolerant(None, True), html)


PLAIN = ['<p class=" a  b ">x<br>y<br/>&amp; &#65;</p>', "<a href='q\"' x=1 y>t</a>", "", "just text", "<!-- c --><i A=\"&lt;\" b=\"\"> \x1c </i>",
         '<u><b z="/"><img src="m.jpg"></b>\n<b z="&">2</b></u>tail', "<!DOCTYPE html><g-1></G-1>"]
OTHER = ["<p>open", "</p>", "<br></br>", "a < b", "<title>a<b></title>", "<p><b></p></b>", "x &amp y", "<p a=\"<\">1</p>", "<>", "<script><p></script>", "<\x00>"]


@pytest.mark.parametrize("pages", [PLAIN, OTHER, PLAIN + OTHER, [p for pair in zip(PLAIN, OTHER) for p in pair] * 3])
def test_pages_read_together_agree(pages):
    """Plain pages of a batch are read at once; what comes out is what reading one by one gives."""
    got = dom._read_batch(_PageReader(None, False), pa.array([*pages, None], pa.string()), False)
    got.validate(full=True)
    assert got.to_pylist() == dom._read_each(_PageReader(None, False), [*pages, ""], False).to_pylist()


def test_plain_pages_are_read_together():
    bad, read = dom._read_together(dom._Shapes(), PLAIN)
    assert not bad.any() and read is not None
    bad, read = dom._read_together(dom._Shapes(), [*PLAIN, "<p>open"])
    assert bad.tolist() == [False] * len(PLAIN) + [True] and read is None


def test_pages_read_together_need_few_steps():
    """What is done for each page in Python does not grow with its tags, whatever their values."""
    pages = pa.array(["".join(f'<p id="{i}-{k}" class="c x{k}">{i}<br></p>' for k in range(40)) for i in range(100)])
    reader, calls = _PageReader(None, False), [0]

    def count(_frame, event, _arg):
        calls[0] += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        got = dom._read_batch(reader, pages, False)
    finally:
        sys.setprofile(None)
    assert calls[0] < 20 * len(pages)  # 100 pages of 120 tags
    assert got.to_pylist() == dom._read_each(_PageReader(None, False), pages.to_pylist(), False).to_pylist()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(
    st.lists(PIECES, max_size=8).map("".join), st.text(alphabet="<>/ab=\"'&;!- \n#1\x1c\x85\u2003é", max_size=30),
    st.lists(st.sampled_from(['<p class="a  b">', "</p>", '<i c="&amp;">', "</i>", "<b x='\"'>", "</b>", "<br>", "&lt;", "t ", "\xa0"]), max_size=8).map("".join),
), max_size=6))
def test_any_pages_of_a_batch_agree(pages):
    """A batch gives what its pages give one by one."""
    got = dom._read_batch(_PageReader(None, False), pa.array(pages, pa.string()), False)
    got.validate(full=True)
    assert got.to_pylist() == dom._read_each(_PageReader(None, False), pages, False).to_pylist()


def test_shapes_are_remembered_in_bounds():
    reader = _PageReader(None, False)
    for i in range(3):
        pages = pa.array([f"<p a{i}x{k}='1'>x</p><p b=\"{k}{'y' * dom._KNOWN_LENGTH}\">z</p>" for k in range(dom._KNOWN_SHAPES)])
        dom._read_batch(reader, pages, False)
        assert len(reader.shapes.kinds) <= 2 * dom._KNOWN_SHAPES + 4 and len(reader.shapes.pieces) <= dom._KNOWN_TAGS
