"""Stages of the corpus pipeline."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op3_minhash, op5_quality, op6_decontaminate, op7_tokens, op8_anchors
from .common import columns, dropped, joined, saved, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def written(df: DataFrame) -> DataFrame:
    """A stage's rows as Parquet in the shared folder, read again."""
    return saved(df)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least 0.3).

    Null and empty texts are scored like any other; rows that repeat an id or a text are judged each; an empty table, or
    one without labelled rows, loses nothing.
    """
    scorer = op5_quality.learned(docs, table(spark, sf_dir, "labels"))
    return op5_quality.kept(docs, scorer)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of whole texts, decoded again: counts and hashes of both, one row for each row of ``docs``.

    Null counts as empty; an empty table gives no rows; other columns are left behind.
    """
    return op7_tokens.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8): the smallest id.

    Rows without words and rows without an id all stay.  Where an id has several different texts, each is a document of
    its own: the one with the smallest hash has the id, the others count as larger than all ids.  Of rows equal in id and
    text the first by all their columns stays.  An empty table gives no rows.
    """
    key = F.coalesce(F.xxhash64("text"), F.lit(0))
    texts = docs.select("doc_id", key.alias("t"), "text")
    counted = texts.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    again = saved(counted.where("rows > 1").select("doc_id", "rows", "lo", "hi"))
    if again.isEmpty():
        found = op3_minhash.near_duplicates(docs, k=5, percent=80)
        gone = saved(found.where("not kept").select("doc_id"))
        dropped(found)
        return docs.join(gone, "doc_id", "left_anti").select(*columns(docs))
    # Texts of an id with several get numbers behind all ids, by id and hash.
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    extra = joined(texts, again.where("lo < hi"), ["doc_id"], "rows").where("t > lo").select("doc_id", "t").distinct()
    number = saved(numbered(extra.orderBy("doc_id", "t"), top + 1).withColumnsRenamed({"doc_id": "x_id", "t": "x_t"}))
    # The columns travel as one, whatever their names.
    rows = docs.select(F.struct(*columns(docs)).alias("row"), "doc_id", key.alias("t"))
    apart = saved(rows.join(number, (F.col("doc_id") == F.col("x_id")) & (F.col("t") == F.col("x_t")), "left").select("row", F.coalesce("number", "doc_id").alias("doc_id"), "t"))
    found = op3_minhash.near_duplicates(apart.select("doc_id", F.col("row")["text"].alias("text")), k=5, percent=80)
    gone = saved(found.where("not kept").select("doc_id").distinct())
    dropped(found)
    dropped(number)
    left = apart.join(gone, "doc_id", "left_anti").withColumn("i", F.col("row")["doc_id"])
    single = left.join(again.select("doc_id"), F.col("i") == again["doc_id"], "left_anti").select("row")
    several = left.join(again.select("doc_id"), F.col("i") == again["doc_id"], "left_semi").groupBy("i", "t").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.unionByName(several).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def numbered(rows: DataFrame, first: int) -> DataFrame:
    """``rows`` with a ``number`` from ``first`` on, in their order: numbers of a partition begin where the one before ends."""
    kept = saved(rows.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    size = {r["part"]: (r["n"], r["low"]) for r in kept.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("low")).collect()}
    begin, total = {}, first
    for part in sorted(size):
        begin[part] = total - size[part][1]
        total += size[part][0]
    if not begin:
        return kept.select(*columns(rows), F.lit(first).cast("long").alias("number"))
    shift = F.create_map(*[x for k, v in begin.items() for x in (F.lit(k), F.lit(v).cast("long"))])
    return kept.select(*columns(rows), (F.col("at") + shift[F.col("part")]).alias("number"))


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of twenty words and more that also start earlier are taken out of the texts; ``n_chars`` follows.

    Every row stays, with an empty text where all of it is a repeat; a null text stays null, and so does a null
    ``n_chars``; of rows that repeat an id the one read first counts as earlier; an empty table gives no rows.
    """
    out = op8_anchors.deduplicated(docs)
    if "n_chars" in out.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.length("text").cast(kind)
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNull(), F.col("n_chars")).otherwise(changed))
    return out.select(*columns(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null and wordless texts hold none and stay; rows that repeat an id or a text are judged each; an empty benchmark
    removes nothing, an empty table gives no rows.
    """
    return op6_decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
