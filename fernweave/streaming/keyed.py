"""Tables that are upserted by key from a stream: log-structured, in key buckets, with a manifest that is swapped last.

A batch writes a run: its rows, one for each key, in folders by bucket (a hash of the key). FAN runs of a level are merged
into one of the next level, so a row is rewritten once a level and a table of n batches has FAN * log(n) runs at most,
however many batches came. A reader merges the runs that the manifest names; of rows with one key it keeps the least or
greatest by the order columns (by batch, if there are none), which is associative: merging runs changes no result.

The manifest is a small file with the names of the runs and the last batch. It is written beside the others under the next
number and renamed into place when its runs are complete, so a reader sees a batch whole or not at all, and a batch that
comes again after its manifest is left out. Runs that a manifest no longer names are deleted by the one after it, so that
readers of the one before aren't disturbed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.streaming.manifest import Manifest

#: Runs of a level that are merged into one of the next.
FAN = 8
BUCKETS = 16
BATCH, BUCKET = "_batch", "_bucket"


class KeyedTable:
    """A table of `schema` with one row for each value of `keys`.

    order: columns (of the table) by which one of several rows with a key is kept, the least if keep is "first", the
    greatest if "last"; without them the batch decides. bucket_by: those of the keys whose hash deals rows into buckets.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], order: list[str] | None = None, keep: str = "last", buckets: int = BUCKETS, fan: int = FAN, bucket_by: list[str] | None = None) -> None:
        if keep not in ("first", "last"):
            raise ValueError("keep is first or last")
        self.spark, self.path, self.schema, self.keys = spark, path, schema, keys
        self.order, self.keep, self.buckets, self.fan, self.bucket_by = order or [BATCH], keep, buckets, fan, bucket_by or keys
        self.columns = spark.createDataFrame([], schema).columns
        self._manifest = Manifest(spark, path, {"applied": -1, "runs": [], "gone": []})

    # the manifest

    def manifest(self) -> dict:
        return self._manifest.read()

    def _swap(self, told: dict) -> None:
        self._manifest.swap(told)

    # runs

    def _rows(self, runs: list[dict]) -> DataFrame:
        schema = f"{self.schema}, {BATCH} bigint, run string, {BUCKET} int"
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/runs").parquet(*[f"{self.path}/runs/run={r['name']}" for r in runs])

    def _one(self, rows: DataFrame, *dealt: str) -> DataFrame:
        """One row for each key. dealt: columns that follow from the key and by which rows lie together already."""
        pick = F.min_by if self.keep == "first" else F.max_by
        rest = [c for c in [*self.columns, BATCH] if c not in self.keys]
        return rows.groupBy(*dealt, *self.keys).agg(pick(F.struct(*rest), F.struct(*self.order)).alias("__row")).select(*dealt, *self.keys, "__row.*")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def _run(self, rows: DataFrame) -> DataFrame:
        """rows, one for each key, as a run has them. They are shuffled once: where a bucket is written, its keys are found."""
        dealt = rows.select(*self.columns, BATCH).withColumn(BUCKET, self._bucket()).repartition(BUCKET)
        return self._one(dealt, BUCKET).sortWithinPartitions(BUCKET, *self.keys)

    def _write(self, rows: DataFrame, name: str) -> None:
        self._run(rows).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/runs/run={name}")

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """Apply a batch; one that was applied changes nothing."""
        told = self.manifest()
        if batch <= told["applied"]:
            return
        name = f"b0x{batch}x{batch}"
        self._write(rows.select(*self.columns).withColumn(BATCH, F.lit(batch).cast("bigint")), name)
        runs, gone = [*told["runs"], {"name": name, "level": 0, "first": batch, "last": batch}], []
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= self.fan:
            first, last = full[0]["first"], full[-1]["last"]
            merged = {"name": f"b{level + 1}x{first}x{last}", "level": level + 1, "first": first, "last": last}
            self._write(self._rows(full), merged["name"])
            runs = sorted([r for r in runs if r["level"] != level] + [merged], key=lambda r: (-r["level"], r["first"]))
            gone += [r["name"] for r in full]
            level += 1
        self._swap({"version": told["version"] + 1, "applied": batch, "runs": runs, "gone": gone})
        for name in told["gone"]:
            self._manifest.delete(f"runs/run={name}")

    def read(self) -> DataFrame:
        """The table as of its newest manifest."""
        return self._one(self._rows(self.manifest()["runs"])).select(*self.columns)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows whose keys are in wanted, which has some of the keys' columns, those of bucket_by among them: only their buckets are read."""
        found = wanted.select(self._bucket().alias("b")).distinct().collect()  # as many as there are buckets at most
        rows = self._rows(self.manifest()["runs"]).filter(F.col(BUCKET).isin([r["b"] for r in found]))
        on = [k for k in self.keys if k in wanted.columns]
        return self._one(rows.join(wanted.select(*on).distinct(), on, "left_semi")).select(*self.columns)
