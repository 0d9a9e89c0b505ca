"""Benchmark decontamination by winnowing, in DataFrame operations only.

Texts are lower-cased (A-Z) and cut into words.  Of the hashes of all 5-word
runs, the smallest in each window of 6 neighbouring ones is a fingerprint
(k = 5, w = 6), so any 10 words in a row hold at least one and equal runs of
10 words hold the same.  Fingerprints of documents are joined with those of
benchmark items; documents with a shared one are extended: all their 10-word
windows are compared with the items' windows by a 64-bit hash of their word
hashes.  Items of fewer words are one window of their own length; winnowing
promises nothing below 10 words, so runs of those lengths are compared
directly.

Words are cut once for all documents, into fingerprints that are written with
the number of words, and once more for the documents found.  The benchmark,
and the ids of documents found, are broadcast where they have at most
``BROADCAST_ROWS`` rows (counted first), and joined by shuffle otherwise; texts
are never broadcast, and shuffled only where the ids are too many.  Places and
items of a document's windows are gathered apart, so a window of many items
that stands in many places costs the sum, not the product.

Results: an empty benchmark hits nothing, an empty table gives no rows; very
long texts are one row like any other; null and wordless texts have no words and no hits; an item's repeated
rows count once; repeated documents are reported each; columns other than
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved

#: Words of a window, of a hashed run, and runs of a winnowing window: RUN + SPAN - 1 = WINDOW.
WINDOW, RUN, SPAN = 10, 5, 6
BROADCAST_ROWS = 1_000_000
_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.filter(F.split(low, _SEPARATORS), lambda w: w != "")


def runs(hashes: Column, k: int) -> Column:
    """A hash of each run of ``k`` neighbours; empty where there are fewer."""
    return F.when(F.size(hashes) >= k, F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[hashes[i + j] for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def winnowed(run_hashes: Column) -> Column:
    """The smallest hash of each window of ``SPAN`` runs, once each."""
    return F.when(F.size(run_hashes) >= SPAN, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(run_hashes) - SPAN), lambda i: F.least(*[run_hashes[i + j] for j in range(SPAN)])))).otherwise(F.array().cast("array<bigint>"))


def _word_hashes(df: DataFrame, *keep: str) -> DataFrame:
    return df.select(*keep, words(F.col("text")).alias("w")).select(*keep, F.transform("w", lambda x: F.xxhash64(x)).alias("w"))


def _sized(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["rid"] == b["rid"])


def hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, rid, n_words)`` of all rows, and ``(doc_id, rid, spans, items)`` of those with windows of items: sorted (first word, words)."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text")
    item = _word_hashes(items.select("item_id", "text"), "item_id").where(F.size("w") > 0).withColumn("len", F.least(F.size("w"), F.lit(WINDOW)))
    lengths = sorted(r["len"] for r in item.select("len").distinct().collect())
    windows = None
    for k in lengths:
        own = item.where(F.col("len") == k).select("item_id", F.lit(k).alias("len"), F.explode(F.array_distinct(runs(F.col("w"), k))).alias("h"))
        windows = own if windows is None else windows.unionByName(own)
    # Words, and what of them can meet an item: fingerprints, and runs of short items' lengths.
    prints = F.array().cast("array<bigint>")
    hashed = _word_hashes(rows, "doc_id", "rid")
    if WINDOW in lengths:
        hashed = hashed.withColumn("r", runs(F.col("w"), RUN))
        prints = winnowed(F.col("r"))
    for k in lengths:
        if k < WINDOW:
            prints = F.concat(prints, runs(F.col("w"), k))
    cut = saved(hashed.select("doc_id", "rid", F.size("w").cast("bigint").alias("n_words"), prints.alias("prints")))
    every = cut.select("doc_id", "rid", "n_words")
    if windows is None:
        return every, rows.limit(0).selectExpr("doc_id", "rid", "cast(null as array<struct<p:int,len:int>>) as spans", "cast(null as array<string>) as items")
    windows = saved(windows.distinct())
    shared = item.where(F.col("len") == WINDOW).select(F.explode(winnowed(runs(F.col("w"), RUN))).alias("h"))
    for k in lengths:
        if k < WINDOW:
            shared = shared.unionByName(item.where(F.col("len") == k).select(F.explode(runs(F.col("w"), k)).alias("h")))
    found = saved(cut.select("doc_id", "rid", F.explode("prints").alias("h")).join(_sized(shared.distinct()), "h", "left_semi").select("doc_id", "rid").distinct())

    # Extension over all windows of those documents.
    again = rows.join(ids := _sized(found), _same(rows, ids), "left_semi")
    once = _word_hashes(again.dropDuplicates(["doc_id", "rid"]), "doc_id", "rid")
    spans = None
    for k in lengths:
        own = once.select("doc_id", "rid", F.lit(k).alias("len"), F.posexplode(runs(F.col("w"), k)).alias("p", "h"))
        spans = own if spans is None else spans.unionByName(own)
    stands = saved(spans.join(_sized(windows.select("len", "h").distinct()), ["len", "h"], "left_semi"))
    dropped(found)
    places = stands.groupBy("doc_id", "rid").agg(F.array_sort(F.collect_set(F.struct("p", "len"))).alias("spans"))
    named = stands.select("doc_id", "rid", "len", "h").distinct().join(_sized(windows), ["len", "h"])
    named = named.select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), "item_id").distinct().groupBy("d", "r").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    both = saved(places.join(named, places["doc_id"].eqNullSafe(named["d"]) & (places["rid"] == named["r"])).select("doc_id", "rid", "spans", "items"))
    dropped(stands)
    return every, both


def covered(spans: Column) -> Column:
    """Words inside any of the sorted spans."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("n"))

    def step(acc: Column, s: Column) -> Column:
        end = s["p"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(end - F.greatest(acc["end"], s["p"]), F.lit(0))).cast("bigint").alias("n"))

    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each document; see the contract of the query."""
    rows, found = hits(docs, items)
    found = _sized(found.select(F.col("doc_id").alias("d"), F.col("rid").alias("r"), covered(F.col("spans")).alias("hit"), "items"))
    none = F.array().cast("array<string>")
    return rows.join(found, rows["doc_id"].eqNullSafe(found["d"]) & (rows["rid"] == found["r"]), "left").select(
        "doc_id",
        "n_words",
        F.coalesce("hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", F.coalesce("items", none)), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a hit, all columns."""
    found = _sized(hits(docs, items)[1].select(F.col("doc_id").alias("d"), F.col("rid").alias("r")))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["d"]) & (F.xxhash64(docs["doc_id"], docs["text"]) == found["r"]), "left_anti")


SQL = r"""
WITH low AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
item AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i FROM item WHERE len(w) > 0)),
ls AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS s FROM (SELECT doc_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS i FROM low, ls WHERE len(w) >= l)),
hit AS (SELECT doc_id, dw.l AS l, i, item_id FROM dw JOIN iw ON dw.l = iw.l AND dw.s = iw.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT low.doc_id, len(w)::BIGINT AS n_words, coalesce(pos.n, 0)::BIGINT AS n_hit, coalesce(its.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(pos.n, 0) > 0 AS contaminated
FROM low LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""
