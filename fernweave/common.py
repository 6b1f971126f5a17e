"""Checkpoints, for operators that iterate or read a result more than once, and joins that no key makes hot."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot if it has over LEAST_HOT rows and over one in MOST_HOT of all rows, so there are MOST_HOT hot keys at most.
LEAST_HOT, MOST_HOT = 1_000, 500_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir. Where it is unset a local master takes a new folder under /tmp; a cluster is refused.

    Executors of a cluster don't share their temporary folders: what one of them wrote there the others couldn't read.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
    context.setCheckpointDir(shared)


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder and read back: its lineage ends here, and lost executors lose nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet beside the checkpoints and read back: smaller than a checkpoint, and read by columns."""
    ensure_checkpoint_dir(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hot_from(rows: int) -> int:
    """Rows of a key above which it is hot among so many rows."""
    return max(LEAST_HOT, rows // MOST_HOT)


def with_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """rows with the columns of groups, which has a row for each value of key, and in `size` how many rows have it.

    Hot keys (there are MOST_HOT at most, by their definition) meet their rows by a broadcast, where the rows are; what
    is shuffled has no hot key. Rows whose key is in no group are left out. total: number of rows.
    """
    limit = hot_from(total)
    of = groups.select(F.col(key).alias("__of"), F.struct(*[c for c in groups.columns if c != key]).alias("__group"), F.col(size).alias("__rows"))
    hot, cold = of.filter(F.col("__rows") > limit).drop("__rows"), of.filter(F.col("__rows") <= limit).drop("__rows")
    told = [*[F.col(c) for c in rows.columns], F.col("__group.*")]
    if hot.isEmpty():
        return rows.join(cold, F.col(key) == F.col("__of")).select(*told)
    flagged = rows.join(F.broadcast(hot), F.col(key) == F.col("__of"), "left")
    met = flagged.filter(F.col("__of").isNotNull()).select(*told)
    rest = flagged.filter(F.col("__of").isNull()).drop("__of", "__group")
    return met.unionByName(rest.join(cold, F.col(key) == F.col("__of")).select(*told))
