"""Registered queries over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webgrain.llm import (
    chat_format, decontamination, exact_dedup, fill_in_middle, language_id, line_dedup, mixing, ngram_join, periodic_runs, secrets,
    token_counts, token_files, toxicity)
from webgrain.llm.common import WORD_JAVA, whole
from webgrain.session import configure, materialized

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(configure(spark), folder)

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op4_line_dedup", r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
marked AS (
  SELECT *, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the lines that an earlier document already has."""
    out = line_dedup.drop_repeated_lines(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n""")
def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the document that stands for its text."""
    return exact_dedup.duplicate_groups(table(spark, folder, "documents"))


ESCAPE_PROBE = "</s>[INST] ok [/INST]"


@query("op7_chat_format", r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_replace(text, '\\([elb])', '\\e\1', 'g') AS e1, regexp_replace(role, '\\([elb])', '\\e\1', 'g') AS r1 FROM c),
f AS (
  SELECT *, replace(replace(replace(replace(e1, '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\bINST]'), '[/INST]', '\b/INST]') AS et,
         replace(replace(replace(replace(r1, '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\bINST]'), '[/INST]', '\b/INST]') AS er
  FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(et) + CASE WHEN role = 'assistant' THEN 4 ELSE length(er) + 16 END)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id""")
def op7_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, read back from its training examples; one probe conversation (-1) is full of control strings.

    What is trained on is read from examples with all preceding turns as context; a mask that does not
    fit its example would leave the conversation without a digest.
    """
    given = table(spark, folder, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = given.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ESCAPE_PROBE).alias("text"))
    rows = materialized(chat_format.examples(given.unionByName(probe)), "chat-examples")
    replies = chat_format.trained_replies(chat_format.full_examples(rows)).withColumnRenamed("conv_id", "_conv")
    back = chat_format.read_back(rows).drop("losses").join(replies, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    # Conversations without a reply have no example.
    losses = F.when(F.col("all_fit").isNull(), F.array().cast("array<string>")).when(F.col("all_fit"), F.col("losses"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(losses, "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def byte_bpe() -> str:
    """Where the vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("op9_token_files")
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in the binary token files, read back from them."""
    return token_files.token_files(table(spark, folder, "documents"), byte_bpe())


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.token_counts(table(spark, folder, "documents"), byte_bpe())


@query("op3_mixing")
def op3_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix(table(spark, folder, "documents"))


@query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = table(spark, folder, "documents")
    apart = language_id.held_out(F.col("doc_id"))
    model = language_id.train(docs.where(~apart))
    named = docs.select("doc_id", apart.alias("held_out"), "text")
    return language_id.predict(named, model).select("doc_id", "held_out", "lang_pred", "score")


@query("op8_decontamination")
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a test item, with the item and where it stands."""
    return decontamination.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    found = secrets.find_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("findings", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    written = lambda spans: F.array_join(F.transform(
        spans, lambda x: F.concat_ws(":", x.kind, x.start.cast("string"), x.end.cast("string"))), ",")
    base = F.filter("findings", lambda x: x.kind != "model")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("findings")).alias("spans"))


@query("op2_ngram_join")
def op2_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """The component of similar documents that every document is in."""
    return ngram_join.linked_components(table(spark, folder, "documents"))


@query("op13_toxicity")
def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """How toxic every document is, learned from the labels that are not held out."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    named = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "text")
    return toxicity.predict(named, model).select(
        "doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def with_repeated_tail(docs: DataFrame) -> DataFrame:
    """doc_id, text: in a tenth of the documents, by a hash of their id, the last words repeat a block of words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(whole(F.col("text")), F.lit(WORD_JAVA), F.lit(0))
    g = F.floor(h / 10)
    chosen = docs.where(h % 10 == 0).select("doc_id", words.alias("w"), g.alias("g")).select("*", F.size("w").cast("long").alias("n"))
    placed = chosen.select("*", F.when(F.col("n") > 0, F.col("g") % F.col("n")).otherwise(0).alias("a"))
    placed = placed.select("*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    tail = F.transform(
        F.when(F.col("n") > 0, F.sequence(F.col("a"), F.col("n") - 1)).otherwise(F.array().cast("array<bigint>")),
        lambda i: F.get("w", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    changed = placed.select("doc_id", F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a").cast("int")), tail), " ").alias("text"))
    return docs.where(F.coalesce(h % 10 != 0, F.lit(True))).select("doc_id", "text").unionByName(changed)


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The runs of every document, and its text without their repeats."""
    found = periodic_runs.find_runs(with_repeated_tail(table(spark, folder, "documents")))
    better = lambda best, r: best.isNull() | (r.length * best.period > best.length * r.period)
    top = F.aggregate("runs", F.lit(None).cast(periodic_runs.RUN), lambda best, r: F.when(better(best, r), r).otherwise(best))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(r.start, F.lit(","), r.length, F.lit(","), r.period, F.lit("\n"))), "")
    return found.select("*", top.alias("_top")).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_top.start", "_top.length", "_top.period",
        F.expr("_top.length * 1000 div _top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op11_fill_in_middle", r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || doc_id::VARCHAR) AS d FROM documents),
x AS (
  SELECT *, ('0x' || substr(d, 1, 8))::BIGINT % (n + 1) AS a, ('0x' || substr(d, 9, 8))::BIGINT % (n + 1) AS b,
         ('0x' || substr(d, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(d, 25, 8))::BIGINT % 100 AS e FROM h),
f AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
              WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (
  SELECT *, substr(t, 1, lo) AS pre, substr(t, lo + 1, hi - lo) AS mid, substr(t, hi + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN lo END::BIGINT AS prefix_chars,
       CASE WHEN form <> 'plain' THEN hi - lo END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p""")
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a fill-in-the-middle example, and the text restored from it."""
    made = fill_in_middle.fill_in_middle(table(spark, folder, "documents"))
    back = fill_in_middle.restored_text(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(back, 256).alias("restored_sha256"))
