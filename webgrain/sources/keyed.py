"""Tables with one row per key that batches are merged into.

A table is a folder::

    data/<version>-<random>/bucket=<n>/…   the rows of some buckets, as one merge left them
    manifests/<version>.json               which folder holds each bucket, and the merge's batch

A row's bucket is a hash of its key.  A merge reads and rewrites only the buckets that
its batch touches, beside the old ones, and then writes the next manifest: a file
that must not exist yet, so the merge shows at once or not at all, and of two
writers at once one fails.  The manifest names the batch: a batch that is given again
changes nothing.  A reader takes the latest manifest and keeps what it names, whatever is merged
meanwhile, until ``vacuum`` deletes what no kept manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from webgrain.session import materialized
from webgrain.sources.files import Store

_BUCKET, _OLD = "__bucket", "__old"
BUCKETS = 64
# Versions that ``vacuum`` leaves to readers.
KEPT = 2


class KeyedTable:
    """``schema`` (DDL) with one row per ``keys``, the latest by ``order``; ``keep`` columns stay as the key's first merged row had them.

    NULL is a key like any other.  Rows that agree in key and order should not differ: which stays is left open.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str], *, keep: tuple[str, ...] = (),
        buckets: int = BUCKETS,
    ) -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.order, self.keep, self.buckets = keys, order, list(keep), buckets
        self._store = Store(spark, path)

    # Manifests -----------------------------------------------------------

    def _versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self._store.names(f"{self.path}/manifests")]

    def _manifest(self, version: int) -> dict:
        return json.loads(self._store.read(f"{self.path}/manifests/{version:010d}.json"))

    def _latest(self) -> dict:
        versions = self._versions()
        if not versions:
            return {"version": 0, "buckets": {}, "count": self.buckets}
        found = self._manifest(versions[-1])
        if found["count"] != self.buckets:
            raise ValueError(f"the table has {found['count']} buckets")
        return found

    def version(self) -> int:
        return self._latest()["version"]

    def applied(self, batch: str) -> bool:
        """Whether a batch has been merged: a short marker for each, or the latest manifest, says so."""
        return self._store.exists(f"{self.path}/batches/{batch}") or self._latest().get("batch") == batch

    # Rows ----------------------------------------------------------------

    def _folders(self, folders: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/data/{x}" for x in sorted(folders)]) if folders else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows of the latest version."""
        return self._folders(list(self._latest()["buckets"].values()))

    def read_for(self, rows: DataFrame) -> DataFrame:
        """The rows of those buckets that the keys of ``rows`` fall into; other buckets are not read."""
        held = self._latest()["buckets"]
        return self._folders([held[b] for b in self._touched(self._bucketed(rows)) if b in held])

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _touched(self, bucketed: DataFrame) -> list[str]:
        # As many short rows as there are buckets, at most.
        return [str(r[0]) for r in bucketed.select(_BUCKET).distinct().collect()]

    def merge(self, changes: DataFrame, batch: str) -> int:
        """Merge a batch and return the version it is in; a batch that was merged before changes nothing.

        ``changes`` has the table's columns; several rows of a key are merged like several batches.
        """
        before = self._latest()
        if self.applied(batch):
            return self._mark(before) if before.get("batch") == batch else before["version"]
        if before.get("batch"):  # its marker may have been lost after its manifest was written
            self._mark(before)
        names = self.spark.createDataFrame([], self.schema).columns
        new = materialized(self._bucketed(changes.select(*names)), "changes")
        touched = self._touched(new)
        if not touched:
            return self._commit({**before, "version": before["version"] + 1, "batch": batch})
        old = self._bucketed(self._folders([before["buckets"][b] for b in touched if b in before["buckets"]]))
        rows = old.withColumn(_OLD, F.lit(0)).unionByName(new.withColumn(_OLD, F.lit(1)))
        rest = [c for c in names if c not in self.keys and c not in self.keep]
        latest = [F.max_by(F.struct(*rest), F.struct(*self.order)).alias("__latest")] if rest else []
        first = [F.min_by(F.struct(*self.keep), F.struct(_OLD, *self.order)).alias("__first")] if self.keep else []
        # Both are mergeable: a hot key is one row for each task before it moves.
        merged = rows.groupBy(_BUCKET, *self.keys).agg(*latest, *first, F.min(_OLD).alias(_OLD))
        merged = merged.select(_BUCKET, *self.keys, *(["__latest.*"] if rest else []), *(["__first.*"] if self.keep else [])).select(_BUCKET, *names)
        folder = f"{before['version'] + 1:010d}-{uuid.uuid4().hex[:12]}"
        # Whole buckets where they are small, parts of one where it is large.
        merged.hint("rebalance", _BUCKET).withColumnRenamed(_BUCKET, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        held = {**before["buckets"], **{b: f"{folder}/bucket={b}" for b in touched}}
        return self._commit({"version": before["version"] + 1, "batch": batch, "buckets": held, "count": self.buckets})

    def _commit(self, manifest: dict) -> int:
        self._store.create(f"{self.path}/manifests/{manifest['version']:010d}.json", json.dumps(manifest))
        return self._mark(manifest)

    def _mark(self, manifest: dict) -> int:
        if not self._store.exists(f"{self.path}/batches/{manifest['batch']}"):
            self._store.create(f"{self.path}/batches/{manifest['batch']}", str(manifest["version"]))
        return manifest["version"]

    def vacuum(self, kept: int = KEPT) -> None:
        """Delete what the last ``kept`` versions do not need, and what failed merges left; no merge may be running."""
        versions = self._versions()
        needed = {f.split("/")[0] for v in versions[-kept:] for f in self._manifest(v)["buckets"].values()}
        for folder in self._store.names(f"{self.path}/data"):
            if folder not in needed:
                self._store.delete(f"{self.path}/data/{folder}")
        for version in versions[:-kept]:
            self._store.delete(f"{self.path}/manifests/{version:010d}.json")
