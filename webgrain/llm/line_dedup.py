"""Lines that repeat across documents, dropped from all but one of them.

Method: explode normalised lines, hash them, count documents per hash, drop the
lines over the threshold, reassemble by position.  DataFrame functions only.

The hash of a line is 128 bits wide (two 64-bit hashes with different seeds).
Counting combines map-side, so a line that is in a third of all documents costs
one row per task.  Only narrow rows (id, position, hash) are joined; a document's
text moves once, to meet its own dropped positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import BLANKS, LAST_ID, ascii_lower, whole
from webgrain.session import materialized

MIN_CHARS = 10
MIN_DOCS = 2


def line_key(line: Column) -> Column:
    """A line without blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _without(lines: Column, dropped: Column) -> Column:
    """``lines`` without the ascending 0-based positions ``dropped``: the gaps between them, joined."""
    ends = F.concat(dropped, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda p: p + 1))
    gaps = F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.flatten(gaps)


def drop_repeated_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
) -> DataFrame:
    """All columns of ``docs`` with the text cleaned, plus ``n_lines`` and ``n_dropped``.

    A key of at least ``min_chars`` code points found in at least ``min_docs``
    rows keeps its lines only in the smallest id that holds it.

    NULL or empty text is one empty line and comes back as ''.  A NULL id comes
    after all others; rows without id keep a line only if no row with an id holds
    it.  Rows that repeat an id are documents of their own and decide alike: with
    the smallest id, each keeps the line.  Extra columns pass through; columns
    named ``n_lines`` or ``n_dropped`` are replaced.  An empty table stays empty.
    """
    text = whole(F.col(text_col))
    narrow = docs.select(
        F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("_id"), text.alias("_text"), F.xxhash64(text).alias("_mark")
    )
    long_enough = lambda k: F.char_length(k) >= min_chars

    # Counting side: each key once per row.
    keys = narrow.select("_id", F.explode(
        F.array_distinct(F.filter(F.transform(_lines(F.col("_text")), line_key), long_enough))).alias("_key"))
    repeated = (
        keys.select("_id", *_hashed(F.col("_key"))).groupBy("h1", "h2")
        .agg(F.min("_id").alias("_keeper"), F.count("*").alias("_docs"))
        .where(F.col("_docs") >= min_docs).drop("_docs")
    )
    # Stored, so that both sides of the join are plain shuffles: Spark splits the places of a line that is everywhere.
    repeated = materialized(repeated, "repeated-lines")
    # Deciding side: each position of each row.
    places = (
        narrow.select("_id", "_mark", F.posexplode(_lines(F.col("_text"))).alias("_pos", "_line"))
        .withColumn("_key", line_key(F.col("_line"))).where(long_enough(F.col("_key")))
        .select("_id", "_mark", "_pos", *_hashed(F.col("_key")))
    )
    dropped = (
        places.join(repeated, ["h1", "h2"]).where(F.col("_id") > F.col("_keeper"))
        .groupBy("_id", "_mark").agg(F.sort_array(F.collect_set("_pos")).alias("_dropped"))
    )
    dropped = materialized(dropped, "dropped-lines")
    out = docs.select(
        F.struct("*").alias("_row"), F.coalesce(F.col(id_col), F.lit(LAST_ID)).alias("_id"), F.xxhash64(text).alias("_mark")
    ).join(dropped, ["_id", "_mark"], "left")
    was = whole(F.col("_row").getField(text_col))
    lines = _lines(was)
    added = {
        text_col: F.when(F.col("_dropped").isNull(), was).otherwise(F.array_join(_without(lines, F.col("_dropped")), "\n")),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.when(F.col("_dropped").isNull(), F.lit(0)).otherwise(F.size("_dropped")).cast("long"),
    }
    kept = [added.pop(c).alias(c) if c in added else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return out.select(*kept, *[c.alias(n) for n, c in added.items()])
