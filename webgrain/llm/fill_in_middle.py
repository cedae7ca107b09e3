"""Fill-in-the-middle examples from documents.

Method: content-defined chunk memoization.  A rolling hash over the bytes of a
text sets chunk borders where the content says so, so that texts which share
passages share chunks.  For each chunk a worker keeps a summary, found by the
chunk's whole content (a dict compares the bytes, so a hash that collides does no
harm): how many units begin in it, whether its first byte goes on with a unit of
the chunk before, and whether its last unit may go on in the next.  The
counts of a text's chunks, added up with those borders in mind, say in which chunk
a cut lies and how many units before; only that chunk is looked into.

Units are code points, or words (``[^\\x20\\x09-\\x0D]+``); a cut after k words is the place
where word k + 1 begins.  Examples come in two orders, prefix first (psm) or
suffix first (spm), each part behind its mark; a text that holds a mark stays plain,
so every example can be turned back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import map_batches, whole, worker_state

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# A border is where this many low bits of the rolling hash are 0: once in 512 bytes.
BORDER_BITS = 9
# No chunk but a text's last is shorter, none is longer.
LEAST_CHUNK = 64
MOST_CHUNK = 1 << 14
# Bytes that the rolling hash sees: each step shifts it by one bit of 32.
WINDOW = 32
# Bytes of chunks that a worker remembers before it starts anew.
MEMORY = 48 << 20
UNITS = ("character", "word")


def _gear() -> np.ndarray:
    """A fixed random number for each byte."""
    state = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    state = (state ^ (state >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (state ^ (state >> np.uint64(27))).astype(np.uint32)


def rolling(data: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """The hash of the ``WINDOW`` bytes that end at each place (fewer at the start)."""
    state = gear[data]
    width = 1
    while width < WINDOW:
        # The hash of 2w bytes is that of the last w plus that of the w before, shifted by w.
        before = state[:-width] << np.uint32(width)
        state = state.copy()
        state[width:] += before
        width *= 2
    return state


def borders(data: bytes, gear: np.ndarray) -> list[int]:
    """Where the chunks of ``data`` end."""
    state = rolling(np.frombuffer(data, np.uint8), gear)
    marks = (np.flatnonzero((state >> np.uint32(32 - BORDER_BITS)) == 0) + 1).tolist()
    out, at = [], 0
    for mark in [*marks, len(data)]:
        while mark - at > MOST_CHUNK:
            at += MOST_CHUNK
            out.append(at)
        if mark - at >= LEAST_CHUNK or mark == len(data) > at:
            out.append(mark)
            at = mark
    return out


def unit_starts(chunk: bytes, unit: str) -> np.ndarray:
    """Where units begin in a chunk; a word in its first byte counts, whatever stands before."""
    code = np.frombuffer(chunk, np.uint8)
    if unit == "character":
        return np.flatnonzero((code & 0xC0) != 0x80)
    inside = ~((code == 32) | ((code >= 9) & (code <= 13)))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    return np.flatnonzero(starts)


class Chunks:
    """Summaries of chunks by content, for one kind of unit.

    A summary is (units that begin, whether the first byte is inside a word, whether the last one is).
    """

    def __init__(self, unit: str = "character") -> None:
        if unit not in UNITS:
            raise ValueError(f"unit is one of {UNITS}")
        self.unit, self.gear = unit, _gear()
        self._known: dict[bytes, tuple[int, bool, bool]] = {}
        self._held = self.hits = self.misses = 0

    def summary(self, chunk: bytes) -> tuple[int, bool, bool]:
        found = self._known.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        self.misses += 1
        if self._held > MEMORY:
            self._known.clear()
            self._held = 0
        blank = b" \t\n\x0b\x0c\r"
        word = self.unit == "word"
        found = len(unit_starts(chunk, self.unit)), word and chunk[0] not in blank, word and chunk[-1] not in blank
        self._known[chunk] = found
        self._held += len(chunk) + 120
        return found

    def measured(self, data: bytes) -> tuple[list[int], list[int], list[int]]:
        """Ends of the chunks, units that begin before each chunk's end, and 1 where a chunk goes on with a word."""
        ends, totals, joins, total, open_word, at = borders(data, self.gear), [], [], 0, False, 0
        for end in ends:
            n, first, last = self.summary(data[at:end])
            joined = int(open_word and first)
            total += n - joined
            totals.append(total)
            joins.append(joined)
            open_word, at = last, end
        return ends, totals, joins

    def cuts(self, data: bytes, units: list[int]) -> tuple[int, list[int]]:
        """All units of ``data``, and the byte place before unit ``k`` (from 0) for each k; beyond the last unit, the end."""
        ends, totals, joins = self.measured(data)
        n, out = totals[-1] if totals else 0, []
        for k in units:
            if k >= n:
                out.append(len(data))
                continue
            chunk = int(np.searchsorted(totals, k, "right"))
            start = ends[chunk - 1] if chunk else 0
            before = totals[chunk - 1] if chunk else 0
            out.append(start + int(unit_starts(data[start:ends[chunk]], self.unit)[k - before + joins[chunk]]))
        return n, out

    def count(self, data: bytes) -> int:
        totals = self.measured(data)[1]
        return totals[-1] if totals else 0


def draws(doc_id: Column, salt: str = "1") -> list[Column]:
    """Eight numbers below 2^32 that depend on the id alone; a NULL id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(8)]


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", unit: str = "character",
    plain_percent: int = 10, spm_percent: int = 20, salt: str = "1",
) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix, middle, suffix, output: one row for each row of ``docs``.

    The cuts and the form depend on the id alone, so reruns agree and rows that repeat an id are
    cut alike.  A text that is empty, holds a mark, or is drawn as plain is its own output and has NULL
    parts.  A NULL text is empty; other columns are ignored; an empty table gives an empty result.
    """
    one, two, three, four = draws(F.col(id_col), salt)[:4]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = worker_state("fill-in-middle")
        chunks = kept.get(unit) or Chunks(unit)
        kept[unit] = chunks
        for batch in batches:
            out: list[list] = [[], [], [], []]
            texts, plain, first, second = (batch.column(k).to_pylist() for k in range(1, 5))
            for text, is_plain, a, b in zip(texts, plain, first, second, strict=True):
                data = text.encode("utf-8", "surrogatepass")
                n = chunks.count(data)
                parts = [None] * 3
                if not is_plain:
                    low, high = sorted((a % (n + 1), b % (n + 1)))
                    _, (i, j) = chunks.cuts(data, [low, high])
                    parts = [p.decode("utf-8", "surrogatepass") for p in (data[:i], data[i:j], data[j:])]
                for column, value in zip(out, [n, *parts], strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(5), pa.array(out[0], pa.int64()), *(pa.array(c, pa.string()) for c in out[1:])],
                ["doc_id", "text", "form", "n", "prefix", "middle", "suffix"])

    text = whole(F.col(text_col))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (three % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(four % 100 < spm_percent, "spm").otherwise("psm")
    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), plain.alias("plain"), one.alias("a"), two.alias("b"), form.alias("form"))
    made = map_batches(given, work, "doc_id long, text string, form string, n long, prefix string, middle string, suffix string")
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle"))
        .otherwise(F.col("text")))
    return made.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored_text(output: Column, form: Column) -> Column:
    """The text that an output was made from."""

    def between(start: str, end: str) -> Column:
        at = F.lit(len(start) + 1)
        return F.substr(output, at, F.locate(end, output, len(start) + 1) - at)

    def after(mark: str) -> Column:
        # Parts hold no mark, so its only place is the one that was written.
        return F.substr(output, F.locate(mark, output) + F.lit(len(mark)))

    def inner(start: str, end: str) -> Column:
        at = F.locate(start, output) + F.lit(len(start))
        return F.substr(output, at, F.locate(end, output) - at)

    return (
        F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), after(MIDDLE), inner(SUFFIX, MIDDLE)))
        .when(form == "spm", F.concat(inner(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX)))
        .otherwise(output))
