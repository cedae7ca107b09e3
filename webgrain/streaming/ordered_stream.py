"""Ordered state and de-duplication on streams without holding a key in a worker (K1, K3, K4).

Rows of a stream arrive out of order.  An epoch keeps rows that are newer than the
watermark (the latest time seen less an allowed delay) in a table beside the stream, and
releases the others in (time, sequence) order: rows of earlier epochs that have come of
age, then the epoch's own.  Released rows get the earlier rows' payloads by the batch
operators of ``ordered``, which cut hot keys into slices, so a key that holds a third of an
epoch is spread over many tasks.  Between epochs a key's latest payloads are rows of a
``KeyedTable``: an epoch rewrites only the buckets of keys it has released.

Everything is named by epoch: one that runs again, after a failure at any point, finds what
it finished or overwrites what it did not.  Give the stream a rate (``maxFilesPerTrigger``) to bound an epoch.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from webgrain.functions.text import let
from webgrain.operators import drift, ordered, pacing
from webgrain.session import materialized
from webgrain.sources.files import Store
from webgrain.sources.keyed import KeyedTable
from webgrain.sources.tables import archive_key

_SEED, _PAYLOAD, _RANK = "__seed", "__payload", "__rank"


class OrderedStream:
    """Hands every row of a stream the ``n`` latest earlier payloads of its key, in event order.

    ``schema`` is the rows' (DDL); ``order`` names the event time first and then what tells rows of one
    time apart.  A row that comes later than ``delay`` allows is not dropped: it goes to ``late`` as it is.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, key: str, order: list[str], payload: Column, n: int, *,
        delay: timedelta, name: str = "earlier", hot_rows: int = ordered.HOT_ROWS,
    ) -> None:
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, order
        self.payload, self.n, self.delay, self.name, self.hot_rows = payload, n, delay, name, hot_rows
        self._store = Store(spark, path)
        empty = spark.createDataFrame([], schema)
        self.columns = empty.columns
        kind = empty.select(payload.alias("p")).schema["p"].dataType.simpleString()
        own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema.fields if f.name in [key, *order])
        self._state = KeyedTable(
            spark, f"{self.path}/state", f"{own}, {_RANK} int, {_PAYLOAD} {kind}, __epoch long", [key, _RANK], ["__epoch"])

    # Epochs --------------------------------------------------------------

    def _done(self) -> list[int]:
        return [int(x.split(".")[0]) for x in self._store.names(f"{self.path}/epochs")]

    def _epoch(self, epoch: int) -> dict:
        return json.loads(self._store.read(f"{self.path}/epochs/{epoch:010d}.json"))

    def _table(self, kind: str, epoch: int) -> str:
        return f"{self.path}/{kind}/epoch={epoch:010d}"

    def add(self, batch: DataFrame, epoch: int) -> None:
        """One micro-batch (for ``foreachBatch``)."""
        self._advance(batch.select(*self.columns), epoch, release_all=False)

    def finish(self) -> None:
        """Release all rows that are still held: the stream has ended, and takes no more rows."""
        done = self._done()
        if done and not self._epoch(done[-1])["finished"]:
            self._advance(self.spark.createDataFrame([], self.schema), done[-1] + 1, release_all=True)

    def _advance(self, batch: DataFrame, epoch: int, release_all: bool) -> None:
        done = self._done()
        last = done[-1] if done else None
        before = self._epoch(last) if done else {"watermark": None, "finished": False}
        if before["finished"]:
            raise ValueError("the stream was finished")
        if done and epoch <= last:
            return
        time = F.unix_micros(F.col(self.order[0]).cast("timestamp"))
        rows = materialized(batch, "epoch-rows")
        newest = rows.agg(F.max(time)).first()[0]
        passed = before["watermark"]
        marks = [passed, None if newest is None else newest - self.delay // timedelta(microseconds=1)]
        mark = max([m for m in marks if m is not None], default=None)
        if passed is not None:
            rows.where(time <= passed).write.mode("overwrite").parquet(self._table("late", epoch))
            rows = rows.where(time.isNull() | (time > passed))
        if last is not None:
            rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(self._table("held", last)))
        # Rows without a time are the first of their key, whenever they come.
        ripe = F.lit(release_all) if release_all or mark is None else F.coalesce(time <= mark, F.lit(True))
        rows.where(~ripe).write.mode("overwrite").parquet(self._table("held", epoch))
        if not (self._state.applied(f"{epoch:010d}") and self._store.exists(f"{self._table('out', epoch)}/_SUCCESS")):
            self._release(rows.where(ripe), epoch)
        self._store.create(f"{self.path}/epochs/{epoch:010d}.json", json.dumps({"watermark": mark, "finished": release_all}))
        for old in [e for e in done if e < last]:
            self._store.delete(self._table("held", old))

    def _release(self, ripe: DataFrame, epoch: int) -> None:
        ripe = ripe.withColumn(_PAYLOAD, self.payload).withColumn(_SEED, F.lit(False))
        keys = ripe.select(self.key).distinct()
        # Earlier payloads stand before all released rows: they are at or below the last watermark.
        kept = self._state.read_for(keys.withColumn(_RANK, F.explode(F.sequence(F.lit(1), F.lit(self.n)))))
        kept = kept.join(keys.withColumnRenamed(self.key, "__key"), F.col(self.key).eqNullSafe(F.col("__key")), "left_semi")
        seeds = kept.select(self.key, *self.order, _PAYLOAD, F.lit(True).alias(_SEED))
        rows = materialized(ripe.unionByName(seeds, allowMissingColumns=True), "released")
        found = ordered.with_history(rows, [self.key], self.order, F.col(_PAYLOAD), self.n + 1, "__all", self.hot_rows).where(~F.col(_SEED))
        earlier = F.slice("__all", F.lit(1), F.size("__all") - 1)
        out = found.select(*self.columns, earlier.alias(self.name))
        out.write.mode("overwrite").parquet(self._table("out", epoch))
        # The latest rows of each key; Spark cuts them down in every task before they move.
        newest = W.partitionBy(self.key).orderBy(*[F.desc(c) for c in self.order])
        top = rows.withColumn(_RANK, F.row_number().over(newest)).where(F.col(_RANK) <= self.n)
        self._state.merge(top.select(self.key, *self.order, _RANK, _PAYLOAD, F.lit(epoch).cast("long").alias("__epoch")), f"{epoch:010d}")

    # Results -------------------------------------------------------------

    def _read(self, kind: str, schema: str) -> DataFrame:
        done = {f"epoch={e:010d}" for e in self._done()}
        there = [x for x in self._store.names(f"{self.path}/{kind}") if x in done]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*[f"{self.path}/{kind}/{x}" for x in there]) if there else self.spark.createDataFrame([], schema)

    def released(self) -> DataFrame:
        """All rows released so far with their earlier payloads, oldest first."""
        kind = self.spark.createDataFrame([], self.schema).select(self.payload.alias("p")).schema["p"].dataType.simpleString()
        return self._read("out", f"{self.schema}, `{self.name}` array<{kind}>")

    def late(self) -> DataFrame:
        """Rows that came after the watermark had passed them."""
        return self._read("late", self.schema)


def run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed all available input to ``each`` micro-batch by micro-batch."""
    (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def drift_alerts(captures: DataFrame, path: str, *, delay: timedelta, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """K1: the alerts of H1 over a stream in event order, with its end flushed.

    ``captures`` (streaming): url, ts, seq, fp, snapshot, hash, size and what of ``drift.ABOUT`` there is.
    """
    about = [c for c in drift.ABOUT if c in captures.columns]
    flat = captures.select("url", "ts", "seq", *about, "fp", "snapshot", "hash", "size")
    own = F.struct(F.col("seq").alias("id"), "fp", "snapshot", "hash", "size")
    kept = OrderedStream(captures.sparkSession, f"{path}/ordered", _ddl(flat), "url", ["ts", "seq"], own, 1, delay=delay, hot_rows=hot_rows)
    run(flat, kept.add, f"{path}/checkpoint")
    kept.finish()
    rows = kept.released().withColumn("alert", drift.drift_alert(F.get("earlier", F.lit(0)), own))
    return rows.where(F.col("alert").isNotNull()).select("url", "ts", "seq", *about, "alert.*")


def pacing_factors(outcomes: DataFrame, path: str, *, delay: timedelta, hot_rows: int = ordered.HOT_ROWS) -> DataFrame:
    """K3: the factor of H4 after every outcome of a stream in event order, with its end flushed."""
    own = pacing.outcome_struct()
    kept = OrderedStream(
        outcomes.sparkSession, f"{path}/ordered", _ddl(outcomes), "host", ["ts", "seq"], own, pacing.WINDOW - 1, delay=delay, hot_rows=hot_rows)
    run(outcomes, kept.add, f"{path}/checkpoint")
    kept.finish()
    history = F.concat("earlier", F.array(own))
    return kept.released().withColumn("factor", let(history, pacing.pacing_factor)).drop("earlier")


class DistinctStream:
    """K4: the first of every page version of a stream, however late its copies come.

    The first tier is Spark's own: a version is remembered for ``recent`` after it arrived, so the state is bounded
    by what arrives in that time, and as arrival is never late no row is dropped unseen.  The second is
    the archive: what passes the first is anti-joined with the archive's keys, of the buckets that its own
    fall into alone, and then merged into them.
    """

    def __init__(self, spark: SparkSession, path: str, *, recent: str = "1 hour", buckets: int = 64) -> None:
        self.spark, self.path, self.recent = spark, path.rstrip("/"), recent
        self._keys = KeyedTable(spark, f"{self.path}/keys", "archive_key string, epoch long", ["archive_key"], ["epoch"], keep=("epoch",), buckets=buckets)
        self._store = Store(spark, path)

    def recently_distinct(self, captures: DataFrame) -> DataFrame:
        """The first tier, on a stream."""
        keyed = captures.withColumn("archive_key", archive_key(F.col("url"), F.col("html")))
        arrived = keyed.withColumn("__arrived", F.current_timestamp()).withWatermark("__arrived", self.recent)
        return arrived.dropDuplicatesWithinWatermark(["archive_key"]).drop("__arrived")

    def add(self, batch: DataFrame, epoch: int) -> None:
        """The second tier, for ``foreachBatch``: an epoch that runs again has the same result."""
        out = f"{self.path}/out/epoch={epoch:010d}"
        if self._store.exists(f"{out}/_SUCCESS") and self._keys.applied(f"{epoch:010d}"):
            return
        rows = materialized(batch, "epoch-captures")
        own = rows.select("archive_key").distinct()
        known = materialized(self._keys.read_for(own).select(F.col("archive_key").alias("__known")), "known-keys")
        fresh = rows.join(known, F.col("archive_key") == F.col("__known"), "left_anti")
        # Within the batch one row for each key: the smallest by all it has.
        first = fresh.select("archive_key", F.struct("*").alias("row")).groupBy("archive_key").agg(F.min("row").alias("row")).select("row.*")
        first.write.mode("overwrite").parquet(out)
        kept = self.spark.read.schema(first.schema).parquet(out)
        self._keys.merge(kept.select("archive_key", F.lit(epoch).cast("long").alias("epoch")), f"{epoch:010d}")

    def captures(self) -> DataFrame:
        """The distinct captures so far."""
        return self.spark.read.parquet(f"{self.path}/out").drop("epoch")

    def run(self, captures: DataFrame) -> DataFrame:
        """All available input of a stream; the distinct captures so far."""
        run(self.recently_distinct(captures), self.add, f"{self.path}/checkpoint")
        return self.captures()
