"""Counters of a stream kept in few file sets (K2).

Every epoch writes one set of partial counters, ``epochs=<n>-<n>``.  When ``fanout``
sets of one level are there, they are folded into one of the next, ``epochs=<first>-<last>``,
so that n epochs are held by at most (fanout - 1) · log(n) sets and every counter is
rewritten log(n) times.  Sets cover fixed ranges of epochs: an epoch that runs again finds its
range covered, or overwrites its own unfinished set, and changes nothing.  A set counts
once Spark has committed it (``_SUCCESS``); readers take the widest ones.
Sets that a wider one replaced are deleted when the next epoch begins, so that a reader has an
epoch's time to finish.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webgrain.operators import memory
from webgrain.sources.files import Store

FANOUT = 8


class RollupStore:
    """Domain counters below ``path``."""

    def __init__(self, spark: SparkSession, path: str, fanout: int = FANOUT) -> None:
        if fanout < 2:
            raise ValueError("fold two sets at least")
        self.spark, self.path, self.fanout, self._store = spark, path.rstrip("/"), fanout, Store(spark, path)

    def _name(self, first: int, last: int) -> str:
        return f"{self.path}/epochs={first:010d}-{last:010d}"

    def sets(self) -> list[tuple[int, int]]:
        """(first, last) epoch of every finished set, by first, the widest of those first."""
        names = [n.split("=")[1] for n in self._store.names(self.path) if n.startswith("epochs=")]
        found = [tuple(map(int, n.split("-"))) for n in names if self._store.exists(f"{self.path}/epochs={n}/_SUCCESS")]
        return sorted(found, key=lambda s: (s[0], -s[1]))

    def widest(self) -> list[tuple[int, int]]:
        """Finished sets that no other one covers."""
        out: list[tuple[int, int]] = []
        for first, last in self.sets():
            if not out or last > out[-1][1]:
                out.append((first, last))
        return out

    def covered(self, epoch: int) -> bool:
        return any(first <= epoch <= last for first, last in self.widest())

    def add(self, outcomes: DataFrame, epoch: int) -> None:
        """Take in the outcomes of an epoch (K2's ``foreachBatch``); one that was taken in before changes nothing."""
        self._drop_replaced()
        if not self.covered(epoch):
            memory.domain_partials(outcomes).write.mode("overwrite").parquet(self._name(epoch, epoch))
        self._fold(epoch)

    def _fold(self, epoch: int) -> None:
        width = self.fanout
        while (epoch + 1) % width == 0:
            first = epoch + 1 - width
            if (first, epoch) not in self.widest():
                parts = [s for s in self.widest() if first <= s[0] and s[1] <= epoch]
                if sum(last - start + 1 for start, last in parts) < width:
                    return  # an epoch is missing: what there is stays as it is
                folded = memory.fold_partials(self.spark.read.parquet(*[self._name(*s) for s in parts]))
                folded.write.mode("overwrite").parquet(self._name(first, epoch))
            width *= self.fanout

    def _drop_replaced(self) -> None:
        for stale in set(self.sets()) - set(self.widest()):
            self._store.delete(self._name(*stale))

    def rollup(self) -> DataFrame:
        """G1 over all epochs so far; None of them: an empty table."""
        sets = self.widest()
        if not sets:
            none = self.spark.createDataFrame([], "domain string, ok boolean, ts timestamp, seq long, error_code string, confidence double")
            return memory.domain_rollup(none)
        return memory.merge_partials(self.spark.read.parquet(*[self._name(*s) for s in sets]))


def fold_stream(outcomes: DataFrame, path: str, checkpoint: str, fanout: int = FANOUT) -> RollupStore:
    """K2: all available outcomes of a stream into compacted counters."""
    store = RollupStore(outcomes.sparkSession, path, fanout)
    (outcomes.writeStream.foreachBatch(store.add).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return store
