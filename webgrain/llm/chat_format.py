r"""Conversations as training examples, one for every assistant turn.

Method: prefix-target expansion.  Every assistant turn becomes an example of its
own with all preceding turns as context, and only that reply is trainable.
DataFrame functions only.

Template::

    <s>role[INST]text[/INST]      a turn of any role but assistant
    text</s>                      an assistant turn

Control strings inside roles and texts are escaped: ``<`` of ``<s>`` and ``</s>``
becomes ``\l``, ``[`` of ``[INST]`` and ``[/INST]`` becomes ``\b``, and a
backslash before e, l or b becomes ``\e``.  All other text stays as it is, and
``unescaped`` is the exact inverse.

Contexts are prefixes of one another, so an example row stores only its
``segment``: what comes after the previous example.  The full example is the
concatenation of the segments up to its own (``full_examples``); the table stays
linear in the conversation, however many replies it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
ASSISTANT = "assistant"


def escaped(text: Column) -> Column:
    out = F.regexp_replace(text, r"\\(?=[elb])", r"\\e")
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(("\\l" if mark[0] == "<" else "\\b") + mark[1:]))
    return out


def unescaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\l"), F.lit("<"))
    out = F.replace(out, F.lit("\\b"), F.lit("["))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def _turn_text(t: Column) -> Column:
    return F.when(t.role == ASSISTANT, F.concat(escaped(t.text), F.lit("</s>"))).otherwise(
        F.concat(F.lit("<s>"), escaped(t.role), F.lit("[INST]"), escaped(t.text), F.lit("[/INST]")))


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, has_target, context_chars, segment, target_start, target_chars.

    ``example`` counts from 1.  The loss mask of an example covers the code points
    [target_start, target_start + target_chars) of its ``segment``; before the
    segment stand ``context_chars`` code points less ``target_start`` of earlier
    segments.  Turns after the last reply make a last row without target, so no turn is lost.

    Turns are ordered by turn, then role, then text; NULL turns come first.  NULL
    text or role is empty (and an empty role is not the assistant).  Repeated rows
    are turns of their own.  A NULL conv_id is one conversation.  Extra columns are
    ignored; an empty table gives an empty result.
    """
    turns = conversations.select(
        "conv_id", F.struct(
            F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    # Ends of the examples: the 1-based places of the replies, and the last turn.
    places = F.transform(F.col("turns"), lambda t, i: F.when(t.role == ASSISTANT, i + 1))
    whole = whole.withColumn("ends", F.array_distinct(F.concat(F.array_compact(places), F.array(F.size("turns")))))
    cut = F.transform(F.col("ends"), lambda end, k: F.struct(
        (k + 1).alias("example"),
        F.slice(F.col("turns"), F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("ends"), k - 1)) + 1,
                end - F.when(k == 0, F.lit(0)).otherwise(F.get(F.col("ends"), k - 1))).alias("part")))
    rows = whole.select("conv_id", F.explode(cut).alias("x")).select("conv_id", "x.example", "x.part")
    last = F.element_at("part", -1)
    rows = rows.select(
        "conv_id", "example", (last.role == ASSISTANT).alias("has_target"),
        F.array_join(F.transform("part", _turn_text), "").alias("segment"),
        F.when(last.role == ASSISTANT, F.char_length(escaped(last.text))).otherwise(F.lit(0)).alias("target_chars"),
    ).withColumn("target_start", F.char_length("segment") - F.when(
        F.col("has_target"), F.col("target_chars") + len("</s>")).otherwise(F.lit(0)))
    return with_context(rows)


def with_context(rows: DataFrame) -> DataFrame:
    """Add ``context_chars``: code points of the whole example before its target."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("example").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn(
        "context_chars", F.coalesce(F.sum(F.char_length("segment").cast("long")).over(before), F.lit(0)) + F.col("target_start"))


def full_examples(rows: DataFrame) -> DataFrame:
    """Write out every example with its whole context: conv_id, example, text, target_start, target_chars.

    Quadratic in the turns of a conversation by its nature; for the final export.
    """
    every = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("example", "segment", "has_target", "context_chars", "target_chars"))).alias("e"))
    each = every.select("conv_id", "e", F.explode("e").alias("x")).where("x.has_target")
    return each.select(
        "conv_id", F.col("x.example").alias("example"),
        F.array_join(F.transform(F.slice(F.col("e"), F.lit(1), F.col("x.example")), lambda y: y.segment), "").alias("text"),
        F.col("x.context_chars").alias("target_start"), F.col("x.target_chars").alias("target_chars"))


def trained_replies(full: DataFrame) -> DataFrame:
    """From whole examples alone: conv_id, losses (the text under each example's mask, in order), all_fit.

    ``all_fit`` says that every example's mask ends where its text does but for the end mark, so that its
    context is all that stands before it.
    """
    target = F.substr(F.col("text"), F.col("target_start").cast("int") + 1, F.col("target_chars"))
    fits = F.char_length("text") == F.col("target_start") + F.col("target_chars") + len("</s>")
    each = full.select("conv_id", F.struct("example", unescaped(target).alias("loss")).alias("e"), fits.alias("fits"))
    return each.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list("e")), lambda e: e.loss).alias("losses"), F.min("fits").alias("all_fit"))


def read_back(rows: DataFrame) -> DataFrame:
    """From example rows alone: conv_id, turns (array of role and text), losses (array), formatted."""
    loss = F.when(F.col("has_target"), unescaped(F.substring(F.col("segment"), F.col("target_start") + 1, F.col("target_chars"))))
    whole = rows.select("conv_id", F.struct("example", "segment", loss.alias("loss")).alias("e")).groupBy("conv_id").agg(
        F.sort_array(F.collect_list("e")).alias("e"))
    whole = whole.select(
        "conv_id", F.array_join(F.transform("e", lambda x: x.segment), "").alias("formatted"),
        F.array_compact(F.transform("e", lambda x: x.loss)).alias("losses"))
    pieces = F.filter(F.split(F.col("formatted"), r"(?<=</s>|\[/INST\])", -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        asked = piece.startswith("<s>")
        role = F.when(asked, unescaped(F.substring_index(F.substr(piece, F.lit(4)), "[INST]", 1))).otherwise(F.lit(ASSISTANT))
        said = F.when(asked, F.substring_index(F.substring_index(piece, "[INST]", -1), "[/INST]", 1)).otherwise(
            F.substring_index(piece, "</s>", 1))
        return F.struct(role.alias("role"), unescaped(said).alias("text"))

    return whole.select("conv_id", F.transform(pieces, turn).alias("turns"), "losses", "formatted")
