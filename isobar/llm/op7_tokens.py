"""SentencePiece encoding and decoding by vectorised merge rounds.

Byte-pair encoding joins, in each word, the neighbouring symbols whose piece
has the best rank, until no pair is a piece.  Here all distinct words of a
batch are one flat array of symbols.  A round looks up every pair at once,
takes the smallest rank of each word (segmented minimum), joins its
occurrences from the left without overlap, and compacts the array; words
without a pair leave.

Joining several occurrences in one round equals joining one at a time unless
the new symbol can at once take part in a piece of equal or better rank.
Those pieces are found when the model is loaded; they are joined one
occurrence a round.

A round costs as much as the word is long, and a word of n symbols may need n
rounds.  Words of more than ``LONG`` symbols, as unspaced text or encoded data
give, therefore take the same merges in the same order from a heap, one by one.

Results: null counts as empty; words and texts of any length are encoded whole; an empty text gives only the begin and end
ids; repeated rows are encoded each for itself; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T

SPACE_MARK = "▁"
#: A worker forgets its words when it holds so many of them, or so many of their ids.
CACHE_WORDS, CACHE_IDS = 400_000, 8_000_000
#: Symbols of a word that vectorised rounds are made for; longer ones use a heap.
LONG = 1_000
_NONE = np.int64(1 << 40)


class Model:
    """Pieces and merge table of a SentencePiece BPE model with byte fallback and identity normalisation."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.byte_id = np.full(256, self.unk, dtype=np.int64)
        special = set()
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                special.add(i)
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                special.add(i)
        normal = {p: i for i, p in enumerate(pieces) if i not in special}
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in normal):
            raise ValueError("a piece reaches over a space: words cannot be encoded apart")
        order = {s: r for r, s in enumerate(sorted({sp.get_score(i) for i in normal.values()}, reverse=True))}
        rank = {p: order[sp.get_score(i)] for p, i in normal.items()}

        def symbol(s: str) -> int | None:
            return normal.get(s, n + ord(s) if len(s) == 1 else None)

        self.width = n + 0x110000
        keys, ranks, joined, unsafe = [], [], [], set()
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is None or b is None:
                    continue
                keys.append(a * self.width + b)
                ranks.append(rank[p])
                joined.append(i)
                unsafe.update(x for x, s in ((a, p[:k]), (b, p[k:])) if len(s) > 1 and rank[p] <= rank[s])
        at = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.array(keys, dtype=np.int64)[at]
        self.ranks = np.array(ranks, dtype=np.int64)[at]
        self.joined = np.array(joined, dtype=np.int64)[at]
        self.unsafe = np.zeros(n, dtype=bool)
        self.unsafe[list(unsafe)] = True
        chars = {ord(p): i for p, i in normal.items() if len(p) == 1}
        self.char_id = np.arange(n, n + 0x110000, dtype=np.int64)
        self.char_id[list(chars)] = list(chars.values())
        # What each id stands for in a decoded text.
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[self.byte_id] = True
        out = []
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                out.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i):
                out.append(b"")
            elif sp.is_unknown(i):
                out.append(" ⁇ ".encode())
            else:
                out.append(p.replace(SPACE_MARK, " ").encode())
        self.out_len = np.array([len(x) for x in out], dtype=np.int64)
        self.out_at = np.concatenate([[0], np.cumsum(self.out_len)])
        self.out_bytes = np.frombuffer(b"".join(out), dtype=np.uint8)
        self.control = np.array([sp.is_control(i) for i in range(n)])
        self.index: dict[str, int] = {}
        self.ids, self.ptr = np.zeros(0, np.int32), np.zeros(1, np.int64)

    # -- encoding ---------------------------------------------------------
    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of the words."""
        length = np.array([len(w) for w in words], dtype=np.int64)
        sym = self.char_id[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        seg = np.repeat(np.arange(len(words)), length)
        if (long := np.flatnonzero(length > LONG)).size:
            first = np.cumsum(length) - length
            keep = np.ones(len(sym), dtype=bool)
            for w in long:
                at = slice(first[w], first[w] + length[w])
                merged = self._merge_long(sym[at])
                sym[first[w] : first[w] + len(merged)] = merged
                keep[first[w] + len(merged) : at.stop] = False
            whole = np.isin(seg, long)
            longs = sym[keep & whole], seg[keep & whole]
            sym, seg = sym[~whole], seg[~whole]
        else:
            longs = sym[:0], seg[:0]
        done_sym, done_seg = [longs[0]], [longs[1]]
        while len(sym):
            rank = np.full(len(sym), _NONE)
            inside = np.flatnonzero(seg[:-1] == seg[1:])
            key = sym[inside] * self.width + sym[inside + 1]
            pos = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            found = self.keys[pos] == key
            at, pos = inside[found], pos[found]
            rank[at] = self.ranks[pos]
            piece = np.zeros(len(sym), dtype=np.int64)
            piece[at] = self.joined[pos]
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            best = np.minimum.reduceat(rank, first)
            over = np.repeat(best == _NONE, size)
            if over.any():
                done_sym.append(sym[over])
                done_seg.append(seg[over])
                left = ~over
                sym, seg, rank, piece = sym[left], seg[left], rank[left], piece[left]
                best, size = best[best != _NONE], size[best != _NONE]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            # One occurrence a round where the new symbol may matter at once.
            own = seg[hit]
            lead = np.r_[True, own[1:] != own[:-1]]
            wary = self.unsafe[piece[hit]]
            if wary.any():
                any_wary = np.zeros(len(hit), dtype=bool)
                starts = np.flatnonzero(lead)
                any_wary = np.repeat(np.logical_or.reduceat(wary, starts), np.diff(np.r_[starts, len(hit)]))
                hit = hit[lead | ~any_wary]
            # From the left without overlap: every second one of a run.
            new_run = np.r_[True, hit[1:] != hit[:-1] + 1]
            run_at = np.maximum.accumulate(np.where(new_run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - run_at) % 2 == 0]
            sym[hit] = piece[hit]
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            sym, seg = sym[keep], seg[keep]
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        at = np.argsort(seg, kind="stable")
        sym, seg = sym[at], seg[at]
        if (rare := np.flatnonzero(sym >= self.n)).size:
            raw = [chr(c).encode("utf-8", "surrogatepass") for c in sym[rare] - self.n]
            count = np.ones(len(sym), dtype=np.int64)
            count[rare] = [len(b) for b in raw]
            where = np.cumsum(count) - count
            sym, seg = np.repeat(sym, count), np.repeat(seg, count)
            sym[T.spread(where[rare], count[rare])] = self.byte_id[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        return sym.astype(np.int32), np.r_[0, np.cumsum(np.bincount(seg, minlength=len(words)))]

    def _merge_long(self, sym: np.ndarray) -> list[int]:
        """The symbols of one word after all merges, best rank and leftmost first."""
        known: dict[int, tuple[int, int] | None] = {}

        def pair(a: int, b: int) -> tuple[int, int] | None:
            key = a * self.width + b
            if key not in known:
                pos = min(int(np.searchsorted(self.keys, key)), len(self.keys) - 1)
                known[key] = (int(self.ranks[pos]), int(self.joined[pos])) if self.keys[pos] == key else None
            return known[key]

        s = sym.tolist()
        n = len(s)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if got := pair(s[i], s[i + 1]):
                heap.append((got[0], i, s[i], s[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:  # one of the two was joined meanwhile
                continue
            s[i], s[j] = pair(a, b)[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if got := pair(s[i], s[k]):
                    heapq.heappush(heap, (got[0], i, s[i], s[k]))
            h = before[i]
            if h >= 0 and (got := pair(s[h], s[i])):
                heapq.heappush(heap, (got[0], h, s[h], s[i]))
        return [x for x in s if x >= 0]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, offsets)`` of whole texts, with begin and end ids."""
        words, per = [], np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            if t:
                found = re.findall(f"{SPACE_MARK}+[^{SPACE_MARK}]*", SPACE_MARK + t.replace(" ", SPACE_MARK))
                per[k] = len(found)
                words += found
        if len(self.index) > CACHE_WORDS or len(self.ids) > CACHE_IDS:
            self.index, self.ids, self.ptr = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
        index = self.index
        if fresh := [w for w in dict.fromkeys(words) if w not in index]:
            ids, ptr = self.merge(fresh)
            index.update(zip(fresh, range(len(index), len(index) + len(fresh)), strict=True))
            self.ids = np.concatenate([self.ids, ids])
            self.ptr = np.concatenate([self.ptr, ptr[1:] + self.ptr[-1]])
        w = np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words))
        count = self.ptr[w + 1] - self.ptr[w]
        before = np.r_[0, np.cumsum(count)]
        edges = before[np.r_[0, np.cumsum(per)]] + 2 * np.arange(len(texts) + 1)
        out = np.empty(edges[-1], dtype=np.int32)
        body = np.ones(len(out), dtype=bool)
        body[edges[:-1]] = False
        body[edges[1:] - 1] = False
        out[edges[:-1]], out[edges[1:] - 1] = self.bos, self.eos
        out[body] = self.ids[T.spread(self.ptr[w], count)]
        return out, edges

    # -- decoding ---------------------------------------------------------
    def decode(self, ids: np.ndarray, edges: np.ndarray) -> list[bytes]:
        """UTF-8 texts of the id runs between ``edges``."""
        size = self.out_len[ids]
        flat = self.out_bytes[T.spread(self.out_at[ids], size)].tobytes()
        cut = np.r_[0, np.cumsum(size)][edges]
        out = []
        for k in range(len(edges) - 1):
            own = ids[edges[k] : edges[k + 1]]
            lead = own[~self.control[own]][:1]
            drop = int(len(lead) > 0 and not self.is_byte[lead[0]] and self.out_len[lead[0]] > 0 and lead[0] != self.unk and self.out_bytes[self.out_at[lead[0]]] == 32)
            raw = flat[cut[k] : cut[k + 1]]
            if self.is_byte[own].any():
                raw = self._repaired(own, raw)
            out.append(raw[drop:])
        return out

    def _repaired(self, own: np.ndarray, raw: bytes) -> bytes:
        """Byte ids that form no character become U+FFFD each."""
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            out, run = [], bytearray()

            def flush():
                at = 0
                while at < len(run):
                    for n in (1, 2, 3, 4):
                        with_n = bytes(run[at : at + n])
                        try:
                            with_n.decode()
                        except UnicodeDecodeError:
                            continue
                        out.append(with_n)
                        at += len(with_n)
                        break
                    else:
                        out.append("�".encode())
                        at += 1
                run.clear()

            for i in own:
                piece = self.out_bytes[self.out_at[i] : self.out_at[i + 1]].tobytes()
                if self.is_byte[i]:
                    run += piece
                else:
                    flush()
                    out.append(piece)
            flush()
            return b"".join(out)


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    """The model at ``path``, loaded once in each worker."""
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, ids array<int>)`` of whole texts, with begin and end ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for rb in T.slices(batches, "text"):
            ids, edges = m.encode(rb.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))], ["id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` as id", f"`{text_col}` as text").mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Encodes and decodes; keeps the number of ids and the hashes of ids and decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for rb in T.slices(batches, "text"):
            ids, edges = m.encode(rb.column(1).to_pylist())
            raw = ids.astype("<u4").tobytes()
            ids_sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            text_sha = [hashlib.sha256(b).hexdigest() for b in m.decode(ids, edges)]
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(np.diff(edges), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
