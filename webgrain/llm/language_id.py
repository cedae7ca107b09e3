"""Language of documents.

Method: multinomial naive Bayes over hashed character n-grams.  Counting is a
distributed sum: every task adds up its own documents and hands on the buckets
it has seen, so neither a document nor a hot source meets the others.  The
log-probability matrix (buckets x languages, a fixed number of buckets) is
broadcast behind a size check.  Scoring is a sparse product in numpy: a document is its list of
buckets, and its scores are the sums of those rows of the matrix.

Text is lower-cased; a run of characters other than letters is one blank, and a
text begins and ends with a blank.  N-grams of ``ORDERS`` characters are hashed
to ``BUCKETS`` buckets; those of blanks alone are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import carried, forget_models, give_back, map_batches, restored, ship, whole

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 18
SMOOTHING = 0.1
UNKNOWN = "und"
# Characters that are hashed at once; bounds the memory of a batch.
BLOCK = 1 << 18
# Buckets that a counting task collects before it adds them up.
WAITING = 1 << 21
# Documents that the stage keeps are at least this sure of their language.
MIN_SCORE = 0.5
HELD_OUT = 2

_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def held_out(doc_id: Column) -> Column:
    """The fixed quarter of documents that training never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def grams(code: np.ndarray) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that starts at each place, for each order; shorter at the end of the text."""
    code = code.astype(np.uint64)
    state = np.zeros(len(code), np.uint64)
    for n in range(max(ORDERS)):
        size = len(code) - n
        if size <= 0:
            return
        state = (state[:size] ^ code[n:]) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(29)
        if n + 1 in ORDERS:
            yield ((state + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int32)


def prepared(text: str) -> np.ndarray | None:
    """Code points of the text as it is counted; None without a letter."""
    if _LETTER.search(text) is None:
        return None
    clean = f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "
    return np.frombuffer(clean.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(code: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in blocks that overlap, so that no n-gram is lost or counted twice."""
    keep = max(ORDERS) - 1
    for at in range(0, len(code), BLOCK):
        yield code[at:at + BLOCK + keep]


def buckets_of(code: np.ndarray) -> Iterator[np.ndarray]:
    blocks = list(pieces(code))
    for k, block in enumerate(blocks):
        for found in grams(block):
            # Only n-grams that start in this block; the last block has all of its own.
            yield found if k == len(blocks) - 1 else found[:BLOCK]


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log probability of each language
    matrix: np.ndarray  # log probability of each bucket (rows) in each language

    def scores(self, codes: list[np.ndarray]) -> np.ndarray:
        """Posterior probabilities, a row for each prepared text."""
        out = np.zeros((len(codes), len(self.languages)))
        for i, code in enumerate(codes):
            out[i] = self.prior
            for found in buckets_of(code):
                # Sparse row of the batch: its non-zero columns, with repeats for counts.
                out[i] += self.matrix[found].sum(axis=0, dtype=np.float64)
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        return out / out.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", smoothing: float = SMOOTHING) -> Model | None:
    """Fit on every row of ``labelled`` with a language; None if there is none with a letter.

    The driver receives one row for each (language, part of the buckets): its size is languages x ``BUCKETS``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        held = 0

        def add_up() -> None:
            nonlocal held
            for name, found in waiting.items():
                into = sums.setdefault(name, np.zeros(BUCKETS, np.int64))
                into += np.bincount(np.concatenate(found), minlength=BUCKETS)
            waiting.clear()
            held = 0

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                code = prepared(text)
                if code is None:
                    continue
                texts[lang] = texts.get(lang, 0) + 1
                for found in buckets_of(code):
                    waiting.setdefault(lang, []).append(found)
                    held += len(found)
                if held >= WAITING:
                    add_up()
        add_up()
        for lang, into in sums.items():
            seen = np.flatnonzero(into)
            at = np.concatenate([[-1], seen])
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at, pa.int32()), pa.array(np.concatenate([[texts[lang]], into[seen]]), pa.int64())],
                ["lang", "bucket", "n"])

    given = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), whole(F.col(text_col)).alias("text"))
    counts = map_batches(given, count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = counts.groupBy("lang", F.pmod("bucket", F.lit(64)).alias("part")).agg(
        F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))
    tables: dict[str, np.ndarray] = {}
    texts: dict[str, int] = {}
    for row in packed.toLocalIterator():
        into = tables.setdefault(row["lang"], np.zeros(BUCKETS))
        at, n = np.array(row["b"]), np.array(row["n"])
        texts[row["lang"]] = texts.get(row["lang"], 0) + int(n[at < 0].sum())
        into[at[at >= 0]] = n[at >= 0]
    if not tables:
        return None
    languages = sorted(tables)
    counted = np.stack([tables[x] for x in languages], axis=1) + smoothing
    matrix = np.log(counted / counted.sum(axis=0)).astype(np.float32)
    have = np.array([texts[x] for x in languages], float)
    return Model(languages, np.log(have / have.sum()), np.ascontiguousarray(matrix))


def predict(docs: DataFrame, model: Model | None, *, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score``, the probability of that language given the text.

    NULL text, text without a letter, and any text if nothing was learned, are
    ``und`` with score 0.  Ties go to the language that is first by code point.
    Columns of these names are replaced; other columns, NULL or repeated ids do not matter.
    """
    spark = docs.sparkSession
    # Plain values only: workers need not have this package.
    shared = ship(spark, model and (model.languages, model.prior, model.matrix), model.matrix.nbytes if model else 0)

    def work(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget_models()
        fitted = shared.value and Model(*shared.value)
        try:
            for texts in columns:
                codes = [None if t is None or fitted is None else prepared(t) for t in texts.to_pylist()]
                known = [i for i, c in enumerate(codes) if c is not None]
                lang, score = [UNKNOWN] * len(codes), [0.0] * len(codes)
                if known:
                    probabilities = fitted.scores([codes[i] for i in known])
                    for i, row in zip(known, probabilities, strict=True):
                        best = int(row.argmax())
                        lang[i], score[i] = fitted.languages[best], float(row[best])
                yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])
        finally:
            give_back()

    work.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    found = F.arrow_udf(work, "lang string, score double").asNondeterministic()(F.col(text_col).cast("string"))
    rows = docs.select(F.struct("*").alias("_row"), found.alias("_found"))
    own = [F.col("_row").getField(c).alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return rows.select(*own, F.col("_found.lang").alias("lang_pred"), F.col("_found.score").alias("score"))


def keep_recognised(docs: DataFrame, *, min_score: float = MIN_SCORE, id_col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` in a language that is recognised with at least ``min_score``; same columns.

    Trained on the labelled rows of ``docs`` that are not held out.  Where there are none, nothing can be
    told apart, so all rows stay.  Rows without text or letters go; NULL or repeated ids and labels do not matter to
    what is kept; an empty table stays empty.
    """
    model = train(docs.where(~held_out(F.col(id_col))))
    if model is None:
        return docs
    named = predict(carried(docs, _text=F.col("text")), model, text_col="_text")
    return restored(named.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)), docs.columns)
