"""Lines that many documents share, in DataFrame operations only.

Texts are split at line feeds.  A line's key is the line without the white
space ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased.  Keys of at least
``LENGTH`` code points that ``DOCUMENTS`` documents or more hold lose their
lines everywhere but in the largest ``doc_id`` that holds them; that document
keeps all of them.  What stays is joined by line feeds in its order.

Plan: lines are exploded once, as 128-bit names of their keys with row and
position, and written; a count of lines for each name (summed before the
shuffle) leaves the names that can reach the threshold; only their lines are
counted by distinct document and met with the decision.  Names travel to the
lines by broadcast while their bytes are few (measured), else by shuffle, names
with very many lines apart (``common.joined``).  Texts are shuffled only where
the positions to drop are too many to broadcast.  Rows with the same id and
text are one row of the lines' table: they have the same result.

Results: an empty table gives no rows; a null or empty text is one empty line;
very long texts are one row like any other (their lines are spread over rows); rows
that share a ``doc_id`` count as one document; rows without ``doc_id`` count as
no document, and lose their lines of dropped keys; repeated rows are reported
each; columns other than ``doc_id`` and ``text`` pass through ``deduplicated``
unchanged and are ignored by ``digests``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, dropped, joined, light, saved

#: Code points of a key, and documents that hold it, from which it is dropped.
LENGTH, DOCUMENTS = 40, 5
_BLANK = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased (``lower`` does the same to ASCII, and faster)."""
    cut = F.btrim(line, F.lit(_BLANK))
    return F.when(F.length(cut) == F.octet_length(cut), F.lower(cut)).otherwise(F.translate(cut, _UPPER, _UPPER.lower()))


def _rid() -> Column:
    return F.xxhash64("text")


def shared_lines(docs: DataFrame, length: int = LENGTH, documents: int = DOCUMENTS) -> DataFrame:
    """``(doc_id, rid, gone)``: positions (from 0) of the lines to drop, for each pair of id and text that has any."""
    each = docs.select("doc_id", _rid().alias("rid"), F.posexplode(lines(F.col("text"))).alias("at", "line"))
    long = each.select("doc_id", "rid", "at", F.btrim("line", F.lit(_BLANK)).alias("line")).where(F.length("line") >= length)
    # Two hashes of different seeds name a key.
    named = saved(long.select("doc_id", "rid", "at", key(F.col("line")).alias("k")).select("doc_id", "rid", "at", F.xxhash64("k").alias("one"), F.xxhash64(F.lit(length), "k").alias("two")))
    often = saved(named.groupBy("one", "two").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") >= documents))
    stands = saved(_met(named, often))
    dropped(named)
    # How many documents hold each, and the largest: distinct pairs first, so that a hot key is spread over its documents.
    held = stands.select("one", "two", "doc_id").distinct().groupBy("one", "two").agg(F.count("doc_id").alias("documents"), F.max("doc_id").alias("keeper"), F.count(F.lit(1)).alias("pairs"))
    over = saved(held.where(F.col("documents") >= documents).join(_small(often), ["one", "two"]).select("one", "two", "keeper", "times"))
    gone = _met(stands.drop("times"), over).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    out = saved(gone.select("doc_id", "rid", "at").distinct().groupBy("doc_id", "rid").agg(F.collect_list("at").alias("gone")))
    for t in (often, stands, over):
        dropped(t)
    return out


def _small(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if light(keys) else keys


def _met(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose name is in ``keys``, with its columns."""
    return rows.join(F.broadcast(keys), ["one", "two"]) if light(keys) else joined(rows, keys, ["one", "two"], "times")


def _with_gone(docs: DataFrame, length: int, documents: int) -> DataFrame:
    """``docs`` with the positions to drop as ``__gone`` (null where there are none)."""
    found = shared_lines(docs, length, documents).select(F.col("doc_id").alias("__d"), F.col("rid").alias("__r"), F.col("gone").alias("__gone"))
    found = F.broadcast(found) if light(found, F.size("__gone") * 4) else found
    return docs.join(found, docs["doc_id"].eqNullSafe(found["__d"]) & (F.xxhash64(docs["text"]) == found["__r"]), "left")


def _kept(parts: Column, gone: Column) -> Column:
    """Lines that stay, joined; the positions left are a difference of sets, so long texts cost no more a line than short ones."""
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone)
    return F.array_join(F.transform(stay, lambda i: parts[i]), "\n")


def deduplicated(docs: DataFrame, length: int = LENGTH, documents: int = DOCUMENTS) -> DataFrame:
    """``docs`` with all its columns; ``text`` without the dropped lines (unchanged, null too, where none goes)."""
    marked = _with_gone(docs, length, documents)
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(_kept(lines(F.col("text")), F.col("__gone")))
    return marked.select(*[text.alias(c) if c == "text" else col for c, col in zip(docs.columns, columns(docs), strict=True)])


def digests(docs: DataFrame, length: int = LENGTH, documents: int = DOCUMENTS) -> DataFrame:
    """One row for each document; see the contract of the query."""
    marked = _with_gone(docs.select("doc_id", "text"), length, documents)
    text = F.coalesce("text", F.lit(""))
    return marked.select(
        "doc_id",
        F.size(lines(F.col("text"))).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(F.when(F.col("__gone").isNull(), text).otherwise(_kept(lines(F.col("text")), F.col("__gone"))), 256).alias("kept_sha256"),
    )


SQL = f"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
line AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS p, unnest(l) AS x FROM l),
k AS (SELECT *, translate(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_UPPER.lower()}') AS k FROM line),
over AS (SELECT k, max(doc_id) AS keeper FROM k WHERE length(k) >= {LENGTH} GROUP BY k HAVING count(DISTINCT doc_id) >= {DOCUMENTS}),
kept AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY p) AS t, count(*) AS n FROM k LEFT JOIN over USING (k) WHERE keeper IS NULL OR keeper = doc_id GROUP BY 1)
SELECT l.doc_id, len(l)::BIGINT AS n_lines, (len(l) - coalesce(n, 0))::BIGINT AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM l LEFT JOIN kept USING (doc_id)
"""
