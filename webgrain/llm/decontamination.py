"""Training documents that hold test items of a benchmark, also edited ones.

Method: rare n-gram seeds join documents to test items, then Smith-Waterman
alignment over words scores the copy.

A copy with a similarity of at least ``SIMILARITY`` lacks and adds a bounded number
of words; each lacking one destroys as many of the item's n-grams as they have words,
each added one at another place one less.  An item's n-grams have the most words, up
to ``SEED_WORDS``, at which one more than can be destroyed exist (at 0.8 mostly two
words; single words always do).  Among one n-gram more than that, one is intact, so
taking the rarest in the corpus (counted over all documents) loses nothing.  Up to
``HITS`` are taken on top, as far as they must be intact, and as many must be found near
one another.  Places that hold too few of the item's words are not aligned.

The items are the stated query set: they are read in blocks of bounded size, each
block goes to all executors behind a size check, and every document meets every
block.  Nothing but matches leaves the tasks, whatever the benchmark's passages
have been copied into.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import LAST_ID, carried, map_batches, restored, ship, text_digest, whole
from webgrain.session import materialized

SEED_WORDS = 3
SIMILARITY = 0.8
HITS = 3
MATCH, MISMATCH, GAP = 2, -1, -1
# Bytes of item text in a block.
BLOCK_BYTES = 2 << 20

_WORD = re.compile(r"\w+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman: score, equal words, begin and end in ``window`` of the best local alignment.

    Row by row; gaps along a row are a running maximum.  Equal words and the begin ride along with the score.
    """
    m = len(window)
    score, same, begin = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64), np.arange(m + 1)
    best = (0, 0, 0, 0)
    places = np.arange(m + 1)
    for word in item:
        hit = window == word
        diagonal = score[:-1] + np.where(hit, MATCH, MISMATCH)
        above = score[1:] + GAP
        take = diagonal >= above
        new = np.zeros(m + 1, np.int64)
        new[1:] = np.maximum(np.where(take, diagonal, above), 0)
        new_same, new_begin = np.zeros(m + 1, np.int64), places.copy()
        alive = new[1:] > 0
        new_same[1:] = np.where(alive, np.where(take, same[:-1] + hit, same[1:]), 0)
        new_begin[1:] = np.where(alive, np.where(take, begin[:-1], begin[1:]), places[1:])
        # A gap in the item: the best cell to the left, less one for each step.
        reach = np.maximum.accumulate(new - GAP * places) + GAP * places
        source = np.maximum.accumulate(np.where(reach == new, places, 0))
        score, same, begin = reach, new_same[source], new_begin[source]
        top = int(score.argmax())
        if score[top] > best[0]:
            best = (int(score[top]), int(same[top]), int(begin[top]), top)
    return best


def gram_keys(code: np.ndarray, size: int) -> np.ndarray:
    """A hash of each n-gram of ``size`` words; a clash only adds a place to align."""
    total = np.zeros(max(0, len(code) - size + 1), np.uint64)
    numbers = (code + 1).astype(np.uint64)
    for k in range(size):
        total = total * _STEP + numbers[k:k + len(total)]
    return total


@dataclass
class Items:
    """A block of test items as word numbers, with its seeds: by size, ascending keys and the (item, place) of each."""

    ids: list[int]
    words: list[np.ndarray]
    number: dict[str, int]
    seeds: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = field(default_factory=dict)
    need: list[int] = field(default_factory=list)

    @staticmethod
    def of(rows: list[tuple[int, str]]) -> Items:
        number: dict[str, int] = {}
        ids, coded = [], []
        for item_id, text in rows:
            code = [number.setdefault(w, len(number)) for w in words(text)]
            if code:
                ids.append(item_id)
                coded.append(np.array(code, np.int64))
        return Items(ids, coded, number)

    def grams(self, similarity: float) -> dict[int, np.ndarray]:
        """By seed size, the ascending keys of all n-grams of the items with seeds of that size."""
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        for code in self.words:
            size = seed_size(len(code), similarity)
            found[size].append(gram_keys(code, size))
        return {size: np.unique(np.concatenate(keys)) for size, keys in found.items()}

    def with_seeds(self, frequency: dict[tuple[int, int], int], similarity: float) -> Items:
        """Keep the rarest n-grams of each item that any copy must share enough of; ``frequency`` is by size and key."""
        seeds: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        need = []
        for i, code in enumerate(self.words):
            size = seed_size(len(code), similarity)
            keys = gram_keys(code, size).tolist()
            lost = destroyed(len(code), size, similarity)
            need.append(min(HITS, len(keys) - lost))
            order = sorted(range(len(keys)), key=lambda k: (frequency.get((size, keys[k]), 0), keys[k], k))
            for k in order[:lost + need[-1]]:
                seeds[size][keys[k]].append((i, k))
        tables = {size: (np.array(sorted(by), np.uint64), [by[g] for g in sorted(by)]) for size, by in seeds.items()}
        return Items(self.ids, self.words, self.number, tables, need)


def coded(number: dict[str, int], text: str) -> np.ndarray:
    """Words of a document; -1 for a word of no item."""
    get = number.get
    return np.array([get(w, -1) for w in words(text)], np.int64)


def allowed(n: int, similarity: float) -> int:
    """Words of an item of ``n`` words that a copy may lack."""
    return n - math.ceil(round(similarity * n, 9))


def destroyed(n: int, size: int, similarity: float) -> int:
    """Most n-grams of ``size`` words that a copy may lack: all over a lacking word, all across an added one elsewhere."""
    most = 0
    for lacking in range(allowed(n, similarity) + 1):
        added = int(round((n - lacking) * (1 / similarity - 1), 9))
        most = max(most, size * lacking + (size - 1) * added)
    return most


def seed_size(n: int, similarity: float) -> int:
    """The most words of an n-gram, so that every copy of an item of ``n`` words has one intact."""
    return next(size for size in range(min(SEED_WORDS, n), 0, -1) if size == 1 or n - size + 1 > destroyed(n, size, similarity))


def places_of(code: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Position in a document and in ``keys`` (ascending) of every n-gram that is among them."""
    own = gram_keys(code, size)
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    found = np.flatnonzero(keys[at] == own)
    return found, at[found]


def matches(items: Items, code: np.ndarray, similarity: float) -> list[tuple[int, float, int, int, int]]:
    """(item, similarity, score, begin, end) of the best copy of each item in a document."""
    hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for size, (keys, owners) in items.seeds.items():
        for at, gram in zip(*(x.tolist() for x in places_of(code, keys, size)), strict=True):
            for i, k in owners[gram]:
                hits[i].append((at - k, k))
    out = []
    for i, found in hits.items():
        if len(found) < items.need[i]:
            continue
        n = len(items.words[i])
        least = n - allowed(n, similarity)
        slack = allowed(n, similarity) + int(n * (1 / similarity - 1)) + 1
        # Hits of one copy lie on diagonals that its edits move by no more than their number.
        found.sort()
        starts = np.array([d for d, _ in found])
        best = None
        last = None
        for a in range(len(found)):
            b = int(np.searchsorted(starts, starts[a] + slack, "right"))
            if len({k for _, k in found[a:b]}) < items.need[i] or (last is not None and b <= last):
                continue
            last = b
            low, high = max(0, int(starts[a]) - slack), min(len(code), int(starts[b - 1]) + n + slack)
            if np.isin(items.words[i], code[low:high]).sum() < least:
                continue
            score, same, begin, end = align(items.words[i], code[low:high])
            alike = same / max(n, end - begin)
            if alike >= similarity and (best is None or (alike, score) > best[:2]):
                best = (alike, score, low + begin, low + end)
        if best is not None:
            out.append((i, *best))
    return out


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, one block on the driver at a time."""
    rows, size = [], 0
    for row in benchmark.select(F.col(item_col).cast("long"), whole(F.col(text_col))).toLocalIterator():
        rows.append((row[0], row[1]))
        size += len(row[1])
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """doc_id, item_id, similarity, score, begin_word, end_word: the best copy of each item in each document that has one.

    The similarity is the equal words of the best alignment over the longer of item and copy.
    Words are runs of letters, digits and underscores in lower case.  NULL or empty
    texts and items without a word match nothing.  Rows that repeat an id are each compared; NULL ids are passed on;
    repeated items give a row each.  Without items or documents the result is empty.
    """
    given = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), whole(F.col(text_col)).alias("text"), F.lit(None).cast("binary").alias("mark"))
    return _found(given, benchmark, item_col, item_text_col, similarity, block_bytes).drop("mark")


def _found(
    given: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text",
    similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``contaminated`` with the ``mark`` of the document beside it; ``given`` has doc_id, text and mark."""
    spark = given.sparkSession
    ddl = "doc_id long, item_id long, similarity double, score long, begin_word long, end_word long, mark binary"
    out = None
    for rows in blocks(benchmark, item_col, item_text_col, block_bytes):
        block = Items.of(rows)
        size = sum(len(text) for _, text in rows) * 64
        found = _block_matches(given, block, size, similarity, ddl)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], ddl) if out is None else out


def _block_matches(given: DataFrame, block: Items, size: int, similarity: float, ddl: str) -> DataFrame:
    spark = given.sparkSession
    grams = block.grams(similarity)
    shared = ship(spark, (block.number, grams), size)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, wanted = shared.value
        seen = {size: np.zeros(len(keys), np.int64) for size, keys in wanted.items()}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                code = coded(number, text)
                for size, keys in wanted.items():
                    seen[size][np.unique(places_of(code, keys, size)[1])] += 1
        for size, counts in seen.items():
            at = np.flatnonzero(counts)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), size)), pa.array(at), pa.array(counts[at])], ["size", "gram", "n"])

    counted = map_batches(given.select("text"), count, "size long, gram long, n long").groupBy("size", "gram").agg(F.sum("n").alias("n"))
    # One row for each n-gram of the block at most.
    frequency = {(r["size"], int(grams[r["size"]][r["gram"]])): r["n"] for r in materialized(counted, "seed-counts").toLocalIterator()}
    block = block.with_seeds(frequency, similarity)
    # Plain values only: workers need not have this package.
    seeded = ship(spark, (block.ids, block.words, block.number, block.seeds, block.need), size)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(*seeded.value)
        for batch in batches:
            rows = []
            for doc_id, text, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                code = coded(items.number, text)
                if len(code):
                    rows += [(doc_id, items.ids[i], alike, score, begin, end, mark)
                             for i, alike, score, begin, end in matches(items, code, similarity)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (
                        pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    ["doc_id", "item_id", "similarity", "score", "begin_word", "end_word", "mark"])

    return map_batches(given, find, ddl)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options,
) -> DataFrame:
    """Rows of ``docs`` whose own text has no copy of a test item, also where ids are NULL or repeat."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID))
    given = docs.select(key.alias("doc_id"), whole(F.col(text_col)).alias("text"), text_digest(F.col(text_col)).alias("mark"))
    found = _found(given, benchmark, **options).select(F.col("doc_id").alias("_bad"), F.col("mark").alias("_bad_mark"))
    bad = materialized(found.distinct(), "leaks").hint("shuffle_hash")
    rows = carried(docs, _key=key, _mark=text_digest(F.col(text_col)))
    same = (F.col("_key") == F.col("_bad")) & (F.col("_mark") == F.col("_bad_mark"))
    return restored(rows.join(bad, same, "left_anti"), docs.columns)
