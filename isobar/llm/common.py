"""Tables, shared storage and sampling that several operators use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups whose shares travel in the plan; those of more groups are joined.
GROUPS = 10_000

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that one key may have on the larger side of a join before they are joined by broadcast, without a shuffle.
HOT_ROWS = 5_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode one of its own where that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="isobar-")
        spark.sparkContext.setCheckpointDir(path)
    return str(path)


def saved(df: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if block_bytes:  # rows of megabytes: readers hold a row group at a time
        writer = writer.option("parquet.block.size", str(block_bytes))
    # What is shuffled for the write is of no use after it: executors delete it then,
    # so that a job of several steps needs the disk of one.
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes a table that ``saved`` made and that nothing reads any more."""
    if path := getattr(df, "_saved_at", None):
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


#: Bytes that a table may have in memory to be broadcast.
LIGHT_BYTES = 64 << 20


def light(df: DataFrame, more: Column | None = None) -> bool:
    """Whether a table is small enough to broadcast: its rows are counted at their fixed width, plus ``more`` bytes of each."""
    width = 16 + 8 * len(df.columns)
    total = df.agg((F.count(F.lit(1)) * width + (F.coalesce(F.sum(more.cast("bigint")), F.lit(0)) if more is not None else 0)).alias("b")).first()["b"]
    return total <= LIGHT_BYTES


def joined(rows: DataFrame, once: DataFrame, keys: list[str], times: str) -> DataFrame:
    """Inner join of ``rows`` with ``once``, which has each key once and says in ``times`` how many rows it can meet.

    Keys that may meet more than ``HOT_ROWS`` rows, of which there are at most
    all rows over ``HOT_ROWS``, are broadcast, so that their rows stay where
    they are; all others are joined by shuffle.
    """
    once = once if hasattr(once, "_saved_at") else saved(once)
    hot = once.where(F.col(times) > HOT_ROWS)
    if hot.isEmpty():
        return rows.join(once, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(once.where(F.col(times) <= HOT_ROWS), keys)
    return cold.unionByName(rows.join(F.broadcast(hot), keys))


def columns(df: DataFrame) -> list[Column]:
    """All columns, also those with dots in their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 5, is 0 (and rows without an id)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def sample(df: DataFrame, group: str, per_group: int, id_col: str = "doc_id") -> DataFrame:
    """About ``per_group`` rows of each group, chosen by a hash of the id; all rows of small groups."""
    count = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    pick = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = {r["_g"]: min(1.0, per_group / r["_n"]) for r in count.limit(GROUPS + 1).collect()}
    if not share:
        return df.limit(0)
    if len(share) > GROUPS:
        cut = count.select("_g", F.least(F.lit(1.0), F.lit(float(per_group)) / F.col("_n")).alias("_share"))
        return df.join(cut, F.col(group) == F.col("_g")).where(pick < F.col("_share")).select(*columns(df))
    cut = F.create_map(*[x for k, v in share.items() for x in (F.lit(k), F.lit(v))])
    return df.where(pick < cut[F.col(group)])
