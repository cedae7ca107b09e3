"""Runs: stretches of a text that repeat a block of words several times in a row.

A run is a maximal stretch of consecutive words with smallest period q (words q
apart are identical) of at least ``LEAST_WORDS`` words and ``LEAST_PERIODS`` periods.

Method: a suffix automaton of the words, whose suffix-link tree is kept as a
link-cut tree.  Preferred paths carry as colour the place where their strings
ended last.  When a word is appended, ``access`` walks from the new state to the
root, one coloured segment after the other: a segment of colour e whose longest
string has L words says that the last L words ended at e before.  If the distance
d = now - e is at most L, the d words before now stand twice in a row: a square,
and a run of period d from now - L - d + 1 on.  The segments are then recoloured.
The run's end is the last place that reports it.  The nearest earlier ends give
the smallest period, so each run appears with that one alone.

Each word of a run occurs in it at least ``LEAST_PERIODS`` times.  Texts are
therefore first cut at words that are rarer than that, again and again within the
remaining stretches, for all texts of a batch at once; the automaton sees only what
is left, and no run is lost.  Memory is linear in the longest stretch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import map_batches, whole

LEAST_WORDS = 6
LEAST_PERIODS = 4
RUN = "struct<start:long,length:long,period:long>"


class RunFinder:
    """Suffix automaton and link-cut tree over one sequence; state 0 is nothing, state 1 the root."""

    def __init__(self) -> None:
        self._next: list[dict[int, int]] = [{}, {}]
        self._link, self._size = [0, 0], [0, 0]
        # Splay trees of the preferred paths, shallow states on the left; colours stand at their roots.
        self._left, self._right, self._up, self._colour = [0, 0], [0, 0], [0, 0], [0, 0]
        self._last, self._n = 1, 0
        self.runs: dict[tuple[int, int], int] = {}  # (start, period) -> end, all from 1

    def append(self, word: int) -> None:
        self._n += 1
        state = self._extend(word)
        self._access(state)

    # Suffix automaton ----------------------------------------------------

    def _new(self, size: int, after: dict[int, int]) -> int:
        self._next.append(after)
        self._size.append(size)
        for column in (self._link, self._left, self._right, self._up, self._colour):
            column.append(0)
        return len(self._size) - 1

    def _extend(self, word: int) -> int:
        follow, link, size = self._next, self._link, self._size
        state, at = self._new(self._n, {}), self._last
        while at and word not in follow[at]:
            follow[at][word] = state
            at = link[at]
        if not at:
            parent = 1
        else:
            parent = follow[at][word]
            if size[parent] != size[at] + 1:
                whole_state = parent
                parent = self._new(size[at] + 1, dict(follow[whole_state]))
                link[parent], link[whole_state] = link[whole_state], parent
                self._between(parent, whole_state)
                while at and follow[at].get(word) == whole_state:
                    follow[at][word] = parent
                    at = link[at]
        link[state] = parent
        self._up[state] = parent
        self._last = state
        return state

    # Link-cut tree -------------------------------------------------------

    def _between(self, clone: int, state: int) -> None:
        """Put ``clone`` on the path of ``state``, right above it."""
        left, up = self._left, self._up
        self._splay(state)
        above = left[state]
        left[clone] = above
        if above:
            up[above] = clone
        left[state] = clone
        up[clone] = state

    def _rotate(self, x: int) -> None:
        left, right, up = self._left, self._right, self._up
        y = up[x]
        z = up[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        up[y] = x
        up[x] = z
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def _splay(self, x: int) -> None:
        left, right, up, rotate = self._left, self._right, self._up, self._rotate
        top = x
        while (y := up[top]) and (left[y] == top or right[y] == top):
            top = y
        if top == x:
            return
        self._colour[x] = self._colour[top]
        while (y := up[x]) and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                rotate(y if (left[z] == y) == (left[y] == x) else x)
            rotate(x)

    def _access(self, state: int) -> None:
        """Report the squares that end here and recolour all suffixes of what was read."""
        now, size, colour, right, up = self._n, self._size, self._colour, self._right, self._up
        below, at = 0, state
        while at:
            self._splay(at)
            if below and colour[at]:
                gap, length = now - colour[at], size[at]
                if length >= gap:
                    self.runs[now - length - gap + 1, gap] = now
            if right[at]:
                colour[right[at]] = colour[at]
            right[at] = below
            below, at = at, up[at]
        colour[below] = now


def runs_of(code: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a sequence, by start, then period."""
    finder = RunFinder()
    for word in code:
        finder.append(word)
    found = []
    for (start, period), end in finder.runs.items():
        length = end - start + 1
        if length >= max(least_words, least_periods * period):
            found.append((start - 1, length, period))
    return sorted(found)


def stretches(text_of: np.ndarray, code: np.ndarray, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int]]:
    """Parts [start, end) of one text each in which every word occurs ``least_periods`` times.

    ``text_of`` says which text each word is from, ascending.  Runs lie within the parts.
    """
    place, part, word = np.arange(len(code)), text_of.astype(np.int64), code.astype(np.int64)
    while len(place):
        key = part * (int(word.max()) + 1) + word
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        stays = count[back] >= least_periods
        all_stay = bool(stays.all())
        place, old, word = place[stays], part[stays], word[stays]
        if not len(place):
            break
        # A new part begins after a gap or where an old one began; short ones go.
        first = np.ones(len(place), bool)
        first[1:] = (np.diff(place) > 1) | (np.diff(old) != 0)
        part = np.cumsum(first) - 1
        long = np.bincount(part)[part] >= least_words
        if all_stay and long.all():
            starts = np.flatnonzero(first)
            return list(zip(place[starts].tolist(), (place[np.append(starts[1:], len(place)) - 1] + 1).tolist(), strict=True))
        place, part, word = place[long], part[long], word[long]
        _, word = np.unique(word, return_inverse=True)
    return []


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return [w for w, gone in zip(words, np.cumsum(step[:-1]).tolist(), strict=True) if not gone]


def find_runs(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
) -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period by start, then period), collapsed: one row for each row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0.  ``collapsed`` are the words that no run
    holds after its first period, joined by one space.  A NULL text is empty: no words, no runs, an empty
    collapsed text.  NULL and repeated ids are passed on; other columns are ignored; an empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [t.encode("utf-8", "surrogatepass").split() for t in batch.column(1).to_pylist()]
            sizes = np.array([len(w) for w in words])
            number: dict[bytes, int] = {}
            code = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(sizes.sum()))
            text_of = np.repeat(np.arange(len(words)), sizes)
            begins = np.concatenate([[0], np.cumsum(sizes)])
            runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
            for start, end in stretches(text_of, code, least_words, least_periods):
                text = int(text_of[start])
                base = start - int(begins[text])
                runs[text] += [(base + s, n, q) for s, n, q in runs_of(code[start:end].tolist(), least_words, least_periods)]
            kept = [b" ".join(collapsed(w, r)).decode("utf-8", "surrogatepass") for w, r in zip(words, runs, strict=True)]
            flat = np.array([r for found in runs for r in found], np.int64).reshape(-1, 3)
            ends = np.cumsum([0] + [len(found) for found in runs])
            packed = pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()),
                pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), packed, pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"))
    return map_batches(given, work, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string")
