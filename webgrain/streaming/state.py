"""Per-key state on streams (K1-K5)."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from webgrain.operators import drift, memory, pacing
from webgrain.session import work_folder
from webgrain.sources.tables import archive_key

# Executors need not have this package installed: ship the processor itself.
register_pickle_by_value(sys.modules[__name__])

_HELD = "__held"


class _LastPayloads(StatefulProcessor):
    """Hands every row the payloads of the key's latest earlier rows."""

    def __init__(self, columns: list[str], order: list[str], n: int) -> None:
        self.columns, self.order, self.n = columns, order, n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", "items array<string>")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self.state.get()[0]) if self.state.exists() else []
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        before = []
        for payload in batch["payload"]:
            before.append(list(held))
            held = [*held, payload][-self.n :]
        self.state.update((held,))
        out = batch[self.columns].copy()
        out[_HELD] = before
        yield out

    def close(self) -> None:
        pass


def with_earlier(stream: DataFrame, key: str, order: list[str], payload: Column, n: int, name: str) -> DataFrame:
    """Add the ``n`` latest earlier payloads of the key (an array, oldest first).

    Rows count in order of arrival; inside a micro-batch they are put in
    ``order``.  Payloads travel as JSON, so any struct can be kept.
    """
    schema = stream.select(payload.alias("p")).schema["p"].dataType
    columns = stream.columns
    rows = stream.withColumn("payload", F.to_json(payload))
    out_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    kept = rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=_LastPayloads(columns, order, n),
        outputStructType=f"{out_schema}, {_HELD} array<string>",
        outputMode="Append",
        timeMode="None",
    )
    parsed = F.transform(_HELD, lambda p: F.from_json(p, schema.simpleString()))
    return kept.withColumn(name, parsed).drop(_HELD)


def drift_alert_stream(captures: DataFrame) -> DataFrame:
    """K1: the alerts of H1 on a stream; the baseline is the capture that arrived before."""
    about = [c for c in drift.ABOUT if c in captures.columns]
    flat = captures.select(
        "url", "ts", "seq", *about, "fp", F.to_json("snapshot").alias("snapshot_json"), "hash", "size"
    )
    entry = "map<string,struct<selector:string,matched:boolean,confidence:double>>"
    payload = F.struct("seq", "fp", "snapshot_json", "hash", "size")
    rows = with_earlier(flat, "url", ["ts", "seq"], payload, 1, "prev")

    def baseline(row: Column | None) -> Column:
        get = (lambda n: F.col(n)) if row is None else (lambda n: row.getField(n))
        return F.struct(
            get("seq").alias("id"), get("fp").alias("fp"), F.from_json(get("snapshot_json"), entry).alias("snapshot"),
            get("hash").alias("hash"), get("size").alias("size"),
        )

    last = F.get("prev", F.lit(0))
    alert = drift.drift_alert(F.when(last.isNotNull(), baseline(last)), baseline(None))
    return rows.withColumn("alert", alert).filter(F.col("alert").isNotNull()).select(
        "url", "ts", "seq", *about, "alert.*"
    )


def pacing_stream(outcomes: DataFrame) -> DataFrame:
    """K3: the factor of H4 after every outcome of a stream."""
    own = pacing.outcome_struct()
    rows = with_earlier(outcomes, "host", ["ts", "seq"], own, pacing.WINDOW - 1, "recent")
    history = F.concat("recent", F.array(own))
    return rows.withColumn("factor", pacing.pacing_factor(history)).drop("recent")


def fold_rollups(outcomes: DataFrame, path: str, checkpoint: str) -> None:
    """K2: keep domain roll-ups up to date.

    Every micro-batch writes its own partial counters (one row per domain) under
    its epoch; a repeated epoch overwrites itself.  ``read_rollups`` merges them.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        memory.domain_partials(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    (outcomes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def read_rollups(spark: SparkSession, path: str) -> DataFrame:
    """K2: the roll-up over all epochs so far."""
    return memory.merge_partials(spark.read.parquet(path).drop("epoch"))


def distinct_captures(captures: DataFrame) -> DataFrame:
    """K4: drop repeated page versions, by their full key, however late they come.

    Every version is remembered (one key of 64 characters in the state store, on
    disk); a watermark would bound that, but drop late captures that were never seen.
    """
    keyed = captures.withColumn("archive_key", archive_key(F.col("url"), F.col("html")))
    return keyed.dropDuplicates(["archive_key"])


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over all available input into a table and return the table."""
    spark = stream.sparkSession
    path = work_folder(spark, name)
    (stream.writeStream.format("parquet").option("path", f"{path}/out")
     .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
     .start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
