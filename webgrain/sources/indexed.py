"""Tables that find rows by an index of files (N5) or of ranges (A4)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from webgrain.functions.urls import domain_of
from webgrain.sources.files import Store
from webgrain.sources.tables import audit_lines

RANGES = 200


class IndexedTable:
    """Files of rows with an index from domain to file, so that a domain is deleted by rewriting the files that hold it.

    A manifest names the files of a version; it appears whole or not at all, and readers keep the version
    they began with.  The index is written beside each set of files and only ever added to: entries of files
    that a manifest no longer names say nothing.  Rows without a readable URL belong to no domain.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, url: str = "url") -> None:
        self.spark, self.path, self.schema, self.url = spark, path.rstrip("/"), schema, url
        self._store = Store(spark, path)

    def _latest(self) -> dict:
        names = self._store.names(f"{self.path}/manifests")
        return json.loads(self._store.read(f"{self.path}/manifests/{names[-1]}")) if names else {"version": 0, "files": [], "change": ""}

    def _commit(self, before: dict, files: list[str], change: str) -> None:
        manifest = {"version": before["version"] + 1, "files": files, "change": change}
        self._store.create(f"{self.path}/manifests/{manifest['version']:010d}.json", json.dumps(manifest))
        self._mark(change)

    def _mark(self, change: str) -> None:
        if change and not self._store.exists(f"{self.path}/changes/{change}"):
            self._store.create(f"{self.path}/changes/{change}", "")

    def _done(self, change: str, before: dict) -> bool:
        if before["change"] != change:
            self._mark(before["change"])
            return self._store.exists(f"{self.path}/changes/{change}")
        self._mark(change)
        return True

    def _write(self, rows: DataFrame) -> list[str]:
        """New files with their part of the index."""
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/data/{folder}")
        files = [f"{folder}/{n}" for n in self._store.names(f"{self.path}/data/{folder}") if n.endswith(".parquet")]
        held = self._files(files).select(
            domain_of(F.col(self.url)).alias("domain"), F.concat(F.lit(f"{folder}/"), F.element_at(F.split(F.input_file_name(), "/"), -1)).alias("file"))
        held.where("domain <> ''").distinct().write.parquet(f"{self.path}/index/{folder}")
        return files

    def _files(self, files: list[str]) -> DataFrame:
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*[f"{self.path}/data/{f}" for f in files]) if files else self.spark.createDataFrame([], self.schema)

    def append(self, rows: DataFrame, change: str) -> None:
        """Add rows; a change that is given again does nothing."""
        before = self._latest()
        if not self._done(change, before):
            columns = self.spark.createDataFrame([], self.schema).columns
            self._commit(before, before["files"] + self._write(rows.select(*columns)), change)

    def read(self) -> DataFrame:
        return self._files(self._latest()["files"])

    def files(self) -> list[str]:
        """The files of the latest version; their names never change while they are not rewritten."""
        return list(self._latest()["files"])

    def files_of(self, domain: str) -> list[str]:
        """Those that hold rows of a domain: at most as many names as there are files."""
        folders = self._store.names(f"{self.path}/index")
        if not folders:
            return []
        index = self.spark.read.schema("domain string, file string").parquet(*[f"{self.path}/index/{x}" for x in folders])
        found = {r["file"] for r in index.where(F.col("domain") == domain).select("file").distinct().collect()}
        return [f for f in self._latest()["files"] if f in found]

    def delete_domain(self, domain: str, change: str, audit_path: str, now: Column) -> None:
        """Delete a domain's rows, with one audit line for each; a change that is given again, or failed half-way, leaves no line twice."""
        before = self._latest()
        if self._done(change, before):
            return
        hit = self.files_of(domain)
        rows = self._files(hit)
        gone = F.coalesce(domain_of(F.col(self.url)) == domain, F.lit(False))
        lines = audit_lines(rows.where(gone).withColumn("ts", now), "deleted")
        lines.write.mode("overwrite").text(f"{audit_path.rstrip('/')}/change={change}")
        left = set(before["files"]) - set(hit)
        self._commit(before, [f for f in before["files"] if f in left] + (self._write(rows.where(~gone)) if hit else []), change)


def forget_domain(tables: dict[str, IndexedTable], domain: str, change: str, audit_path: str, now: Column) -> None:
    """Delete a domain from all stored tables, each with audit lines of its own."""
    for name, table in tables.items():
        table.delete_domain(domain, change, f"{audit_path.rstrip('/')}/{name}", now)


class PageIndex:
    """Deep pages of a listing (A4): keys sorted into ranges once, with counts, so that a page reads the ranges that hold it.

    ``order`` sorts the listing and should tell rows apart; ``keys`` are columns that find a row in the stored table.
    """

    def __init__(self, spark: SparkSession, path: str, order: list[Column], by: str = "platform") -> None:
        self.spark, self.path, self.order, self.by = spark, path.rstrip("/"), order, by

    def build(self, stored: DataFrame, keys: list[str], ranges: int = RANGES) -> None:
        """Keys alone are sorted.  A range is cut by the whole order, so rows of one time need not share it."""
        rows = stored.select(self.by, *keys).repartitionByRange(ranges, *self.order).withColumn("range", F.spark_partition_id())
        rows.write.partitionBy("range").parquet(f"{self.path}/ranges")
        counted = self.spark.read.parquet(f"{self.path}/ranges").groupBy("range", self.by).agg(F.count(F.lit(1)).alias("n"))
        counted.coalesce(1).write.parquet(f"{self.path}/counts")

    def ranges_of(self, offset: int, limit: int, value: str | None = None) -> tuple[list[int], int]:
        """The ranges that hold a page, and where it begins in them; reads counts alone."""
        counts = self.spark.read.parquet(f"{self.path}/counts")
        counts = counts if value is None else counts.where(F.col(self.by) == value)
        # A row for each range.
        held = counts.groupBy("range").agg(F.sum("n").alias("n")).orderBy("range").collect()
        at, out, skip = 0, [], 0
        for row in held:
            if at + row["n"] > offset and at < offset + limit:
                if not out:
                    skip = offset - at
                out.append(row["range"])
            at += row["n"]
        return out, skip

    def page(self, offset: int, limit: int, value: str | None = None) -> DataFrame:
        """The keys of one page, in order; only its ranges are read and sorted."""
        ranges, skip = self.ranges_of(offset, limit, value)
        rows = self.spark.read.parquet(f"{self.path}/ranges").where(F.col("range").isin(ranges) if ranges else F.lit(False))
        rows = rows if value is None else rows.where(F.col(self.by) == value)
        return rows.drop("range").orderBy(*self.order).offset(skip).limit(limit)

    def results(self, stored: DataFrame, key: str, offset: int, limit: int, value: str | None = None) -> DataFrame:
        """The page's rows of the stored table; those without output are dropped after paging, as in ``list_results``."""
        # At most ``limit`` keys.
        keys = [r[key] for r in self.page(offset, limit, value).select(key).collect()]
        return stored.where(F.col(key).isin(keys) & F.col("output_json").isNotNull()).orderBy(*self.order) if keys else stored.where("false")
