"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts of ``ORDER`` bytes and fewer holds
how often each byte followed each context.  With frozen counts (escape method
C) a byte ``s`` after context ``c`` costs ``-log2(n(c, s) / (N(c) + T(c)))``
bits if the context has been followed by it (N: all followers, T: distinct
ones), else ``-log2(T(c) / (N(c) + T(c)))`` bits for an escape plus its cost
in the next shorter context; an unknown context is passed without cost.  Below
order 0 all 256 bytes are alike.  A text's code length in a language is the
exact sum over its bytes; the shortest code names the language, and ``score``
is its share of ``2 ** -length`` over the languages, with lengths a byte
tempered by ``TEMPER`` bytes.

The counts depend on (context, byte) alone, so each worker turns them into
tables ``[context node, byte symbol, language]`` and a text is scored by adding
up table rows.  Bytes that no training text has share a symbol.  A table holds
at most ``BLOCK`` languages, with the contexts and bytes of these alone, so the
tables grow with the languages and not with their square; a context that is
unknown to a language costs nothing, so the blocks do not change a code length.

Training reads whole texts of at most about ``SAMPLE`` documents a language
(by a hash of the id, so the same ones each time), counted where they lie and
summed by (language, context and byte).

Results: ``lang_pred`` is ``und`` with score 0 where the text is null or has
no letter, or where nothing could be learned; ties go to the first language in
order; repeated rows are scored each for itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import sample

#: Bytes of context; training documents a language; bytes over which code lengths are tempered; languages of one table.
ORDER, SAMPLE, TEMPER, BLOCK = 3, 1500, 256, 8


def grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """``(lang, size, gram, n)``: how often each run of ``size`` bytes (1 to order + 1) is in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in T.slices(batches, "text", 1 << 20):
            for lang in pc.unique(rb.column(0)).to_pylist():
                raw, off = T.flat(rb.column(1).filter(pc.equal(rb.column(0), lang)))
                code = np.zeros(len(raw), dtype=np.uint64)
                room = np.repeat(off[1:], np.diff(off)) - np.arange(len(raw))
                for size in range(1, order + 2):
                    code = code[: max(0, len(raw) - size + 1)] << np.uint64(8) | raw[size - 1 :]
                    gram, n = np.unique(code[room[: len(code)] >= size], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(np.full(len(gram), size, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "size", "gram", "n"])

    each = docs.selectExpr("lang", "text").mapInArrow(run, "lang string, size int, gram long, n long")
    return each.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class Ppm:
    """Code lengths of texts in each language, from (language, size, gram, count)."""

    def __init__(self, langs: list[str], lang: np.ndarray, size: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int = ORDER, block: int = BLOCK):
        self.langs, self.order, self.parts = langs, order, []
        count = len(langs)
        if not count:
            return
        if count > block:
            for c in range(0, count, block):
                here = (lang >= c) & (lang < c + block)
                self.parts.append(Ppm(langs[c : c + block], lang[here] - c, size[here], gram[here], n[here], order, block))
            return
        seen = np.unique(gram[size == 1]).astype(np.int64)
        self.symbol = np.zeros(256, dtype=np.int64)
        self.symbol[seen] = np.arange(1, len(seen) + 1)
        a = self.width = len(seen) + 1

        def recoded(g: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(len(g), dtype=np.int64)
            for j in range(k - 1, -1, -1):
                out = out * a + self.symbol[g >> (8 * j) & 255]
            return out

        # Cost of each symbol in each node, one order after the other; order 0 has one node.
        cost = np.full((1, a, count), 8.0)
        node = np.zeros(1, dtype=np.int64)  # of each context code of the order before
        self.nodes = []  # the same for each order
        for k in range(order + 1):
            has = size == k + 1
            code, lg, num = recoded(gram[has].astype(np.int64), k + 1), lang[has], n[has].astype(float)
            ctx = code // a
            known = np.unique(ctx)
            at = np.searchsorted(known, ctx)
            total = np.zeros((len(known), count))
            kinds = np.zeros((len(known), count))
            np.add.at(total, (at, lg), num)
            np.add.at(kinds, (at, lg), 1)
            short = node[known % a ** max(k - 1, 0)] if k else np.zeros(len(known), dtype=np.int64)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(kinds > 0, np.log2((total + kinds) / kinds), 0.0)
                new = cost[short] + escape[:, None, :]
                new[at, code % a, lg] = np.log2((total + kinds)[at, lg] / num)
            if k:
                child = np.tile(node, a) if k > 1 else np.zeros(a, dtype=np.int64)
                child[known] = len(cost) + np.arange(len(known))
                cost, node = np.concatenate([cost, new]), child
            else:
                cost = new if len(new) else cost
            self.nodes.append(node.astype(np.int32))
        self.node = node.astype(np.int32)
        self.cost = np.ascontiguousarray(cost, dtype=np.float32).reshape(-1, count)

    def lengths(self, raw: np.ndarray, off: np.ndarray, short: bool = False) -> np.ndarray:
        """Bits of each text in each language, each byte under the ``order`` bytes before it.

        The first ``order`` bytes of a text are taken under order 0, or with ``short`` under the bytes that they have before them.
        """
        if self.parts:
            return np.concatenate([p.lengths(raw, off, short) for p in self.parts], axis=1)
        rows = len(off) - 1
        out = np.zeros((rows, len(self.langs)))
        if not len(raw) or not len(self.langs):
            return out
        s, a, k = self.symbol[raw], self.width, self.order
        ctx = np.zeros(len(raw), dtype=np.int64)
        for j in range(k):
            ctx[k:] += s[k - 1 - j : len(raw) - 1 - j] * a**j
        at = self.node[ctx].astype(np.int64) * a + s
        at[T.spread(off[:-1], np.minimum(k, np.diff(off)))] = s[T.spread(off[:-1], np.minimum(k, np.diff(off)))]  # the first bytes under order 0
        for j in range(1, k if short else 0):
            here = off[:-1][np.diff(off) > j] + j
            code = np.zeros(len(here), dtype=np.int64)
            for i in range(j):
                code += s[here - 1 - i] * a**i
            at[here] = self.nodes[j][code].astype(np.int64) * a + s[here]
        full = np.flatnonzero(np.diff(off))
        out[full] = np.add.reduceat(self.cost[at].astype(np.float64), off[full], axis=0)
        return out

    def predict(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(number of the language, score)``."""
        bits = self.lengths(raw, off, short=True)
        size = np.maximum(np.diff(off), 1)
        best = bits.argmin(axis=1)
        gap = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1.0, TEMPER / size)[:, None]
        return best, 1.0 / np.exp2(-np.minimum(gap, 500)).sum(axis=1)


_built: dict[str, Ppm] = {}


def predict(docs: DataFrame, train: DataFrame, per_language: int = SAMPLE, order: int = ORDER) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` to (doc_id, held_out, text) rows; learns from (lang, text) of ``train``."""
    counts = grams(sample(train, "lang", per_language), order).toPandas()
    langs = sorted(counts["lang"].unique())
    number = {x: i for i, x in enumerate(langs)}
    got = (langs, counts["lang"].map(number).to_numpy(np.int64), counts["size"].to_numpy(np.int64), counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.int64))
    shared, key = docs.sparkSession.sparkContext.broadcast(got), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = Ppm(*shared.value, order)
        ppm = _built[key]
        names = pa.array(ppm.langs or ["und"], pa.string())
        for rb in T.slices(batches, "text", 1 << 20):
            raw, off = T.flat(rb.column(2))
            letters = np.array(rb.column(3).to_numpy(zero_copy_only=False), dtype=bool) & bool(ppm.langs)
            best, score = ppm.predict(raw, off) if ppm.langs else (np.zeros(rb.num_rows, np.int64), np.zeros(rb.num_rows))
            lang = pc.if_else(pa.array(letters), names.take(pa.array(best)), pa.scalar("und", pa.string()))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), lang, pa.array(np.where(letters, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    ready = docs.select("doc_id", "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return ready.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
