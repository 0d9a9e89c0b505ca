"""Line dedup, hard negatives and centroid clusters against brute force."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from isobar.llm import common, op11_lines, op12_negatives, op13_clusters, queries

from .helpers import awkward, docs, frame

# -- lines --------------------------------------------------------------------


def dropped_lines(rows: list[tuple], length=40, documents=5) -> list[tuple]:
    """The contract, read literally: ``(doc_id, n_lines, n_dropped, kept text)``."""
    blank = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blank).translate(low)
    held = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= length and d is not None:
                held[key(x)].add(d)
    out = []
    for d, t in rows:
        parts = (t or "").split("\n")
        stay = [x for x in parts if len(key(x)) < length or len(held[key(x)]) < documents or max(held[key(x)]) == d]
        out.append((d, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[3]))


def of_lines(df) -> list[tuple]:
    return sorted([(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in df.collect()], key=str)


def sha(rows):
    return sorted([(*r[:3], hashlib.sha256(r[3].encode()).hexdigest()) for r in rows], key=str)


def line_rows(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    pool = ["".join(rng.choice("abcdefgh é") for _ in range(n)) + "xyz" for n in (20, 36, 37, 38, 60, 90, 200)]
    pool += ["Common LINE of the corpus that is long enough to count", "straße und fluß im über größeren zusammenhang der zeilen", "ΣΙΣΥΦΟΣ ΚΑΙ Η ΠΕΤΡΑ ΤΟΥ ΣΤΗΝ ΚΟΡΥΦΗ ΤΟΥ ΒΟΥΝΟΥ ΞΑΝΑ"]
    rows = []
    for d in range(60):
        parts = []
        for _ in range(rng.randrange(0, 9)):
            x = rng.choice(pool) if rng.random() < 0.7 else f"only here {d} {rng.random()} {rng.random()}"
            if rng.random() < 0.4:
                x = rng.choice([" ", "\t", "\x0b", "\r", "  \x0c"]) + x + rng.choice(["", " ", "\r", "\t "])
            parts.append(x.upper() if x.isascii() and rng.random() < 0.3 else x)
        rows.append((d, "\n".join(parts)))
    return rows


def test_lines_equal_brute_force(spark):
    for seed in (1, 2):
        rows = line_rows(seed) + [(100 + k, t) for k, t in enumerate(awkward())]
        df = frame(spark, [(d, t, "en", "s", 1) for d, t in rows], parts=5)
        assert of_lines(op11_lines.digests(df)) == sha(dropped_lines(rows))


def test_lines_repeated_rows_null_ids_and_other_columns(spark):
    line = "a line of boilerplate that is surely longer than forty code points"
    rows = [(1, line), (1, line), (2, f"{line}\nkeep\n{line}"), (3, None), (None, f"x\n{line}"), (4, line), (5, line.upper()), (6, f"  {line}\t\nlast\n")]
    many = rows + [(5, line + "\n" + line)]  # five documents; 6 is the largest
    df = frame(spark, [(d, t, 1, 2, 3) for d, t in many], "doc_id long, text string, gone int, `one.two` int, __line int")
    assert of_lines(op11_lines.digests(df)) == sha(dropped_lines(many))
    kept = op11_lines.deduplicated(df)
    assert kept.columns == df.columns
    texts = {(r["doc_id"], r["text"]) for r in kept.collect()}
    assert (3, None) in texts and (2, "keep") in texts and (6, f"  {line}\t\nlast\n") in texts and (None, "x") in texts
    four = [r for r in many if r[0] not in (5, 6)]  # three documents only: everything stays
    assert of_lines(op11_lines.digests(frame(spark, four, "doc_id long, text string"))) == sha(dropped_lines(four))
    assert op11_lines.digests(docs(spark, [])).collect() == []


def test_lines_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "LIGHT_BYTES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    rows = line_rows(3) + [(200 + k, "the one line that a third of all documents have, and more of them") for k in range(30)]
    assert of_lines(op11_lines.digests(frame(spark, rows, "doc_id long, text string"))) == sha(dropped_lines(rows))


def test_line_query_is_native(spark, data):
    plan = queries.op11_line_dedup(spark, data)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# -- vectors ------------------------------------------------------------------

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(v) -> list[int]:
    return [math.floor(256 * float(np.float32(x))) for x in v]


def taking(rows):
    return [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


def negatives(rows: list[tuple], every=100) -> list[tuple]:
    rows = [(i, whole(v), (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in dict.fromkeys((i, tuple(v) if v is not None else None, y) for i, v, y in rows) if i is not None and y is not None and taking([(i, v, y)])]
    first = {}
    for r in sorted(rows, key=lambda r: (r[2], r[1])):
        if r[0] % every == 0:
            first.setdefault(r[0], r)
    out = []
    for a in first.values():
        scored = sorted(((sum(p * q for p, q in zip(a[1], b[1])), b) for b in rows if b[0] != a[0]), key=lambda x: (-x[0], x[1][0]))  # noqa: B905
        for ps, p in [x for x in scored if x[1][2] == a[2]][:5]:
            found = [x for x in scored if x[1][2] != a[2] and 80 * ps <= 100 * x[0] <= 100 * ps][:5]
            out += [(a[0], p[0], k + 1, n[0], ps, ns) for k, (ns, n) in enumerate(found)]
    return sorted(out)


def of_negatives(df) -> list[tuple]:
    return sorted(tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in df.collect())


def vectors(seed: int, n: int, norms: bool = True, dim: int = 8) -> list[tuple]:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None] + 1e-9
    if norms:
        x *= rng.choice([0.01, 0.2, 1, 1, 3], size=n)[:, None]
    return [(k, [float(v) for v in x[k]], int(rng.integers(0, 4))) for k in range(n)]


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op12_negatives, "BUCKET", 64)
    monkeypatch.setattr(op12_negatives, "BLOCK", 5)
    monkeypatch.setattr(op12_negatives, "ROUND", 40)
    for seed, norms in ((1, True), (2, False)):
        rows = vectors(seed, 700, norms)
        df = frame(spark, rows, SCHEMA, parts=6)
        assert of_negatives(op12_negatives.mined(df, every=7)) == negatives(rows, every=7)


def test_negatives_awkward_rows(spark):
    rows = vectors(5, 120)
    copy = rows[3][1]
    rows += [(1000 + k, copy, k % 3) for k in range(90)]  # ties: one vector, three labels
    rows += [(200, [0.0] * 8, 1), (201, [0.0] * 8, 2), (202, [0.0] * 8, 1), (300, [0.5, 0.5], 1), (400, [], 2), (None, copy, 1), (500, None, 1), (600, copy, None), (700, [1.0, None] * 4, 1), (800, [float("nan")] * 8, 1), (801, [float("inf")] * 8, 1), (900, copy, 2), (900, copy, 2), (900, rows[9][1], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", text string, norm int").repartition(4)
    assert of_negatives(op12_negatives.mined(df)) == negatives(rows)
    assert of_negatives(op12_negatives.mined(df.limit(0))) == []
    with pytest.raises(Exception, match="134217728"):
        op12_negatives.mined(frame(spark, [(0, [1e6] * 3, 1), (1, [1.0] * 3, 1)], SCHEMA)).collect()


def test_negatives_prune_by_norm():
    """A bucket whose bound is below every window is not scored, and the result is the same."""
    rng = np.random.default_rng(4)
    pack = lambda x, ids, y: op12_negatives._pack([_batch(x, ids, y)]).to_pylist()[0]
    a = rng.integers(-200, 200, (3, 6))
    near, far = rng.integers(-300, 300, (50, 6)), rng.integers(-2, 3, (50, 6))
    block = pack(a, np.arange(3) + 1000, np.zeros(3, int))
    best = op12_negatives._Best(block, False)
    for x, ids in ((near, np.arange(50)), (far, np.arange(50) + 50)):
        b = pack(x, ids, np.zeros(50, int))
        best.meet(b, np.frombuffer(b["ids"], np.int64), np.frombuffer(b["labels"], np.int64), np.frombuffer(b["vectors"], np.int32).reshape(50, 6), 300)
    assert best.scored == 150  # the second bucket's bound is below all fifth scores
    assert best.score[:, 0, 0].tolist() == (a @ near.T).max(axis=1).tolist()


def _batch(x, ids, y):
    import pyarrow as pa

    return pa.record_batch([pa.array(ids), pa.array(y), pa.array(np.linalg.norm(x, axis=1)), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["vec_id", "label", "norm", "v"])


def clusters(rows: list[tuple], k=40, rounds=5) -> list[tuple]:
    kept = [(i, whole(v)) for i, v, _ in taking(rows) if len(v) == 64]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    if not start:
        return []
    c = [list(v) for _, v in start]
    gap = lambda v, w: sum((a - b) ** 2 for a, b in zip(v, w))  # noqa: B905, E731
    near = lambda v: min((gap(v, w), j) for j, w in enumerate(c))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]  # all are assigned before any centroid moves
        for j in range(len(c)):
            own = [v for (_, v), p in zip(kept, at) if p == j]  # noqa: B905
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own)]  # noqa: B905
    final = [(i, *near(v)) for i, v in kept]
    inertia = defaultdict(int)
    for _, d, j in final:
        inertia[j] += d
    return sorted(((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in final), key=str)


def of_clusters(df) -> list[tuple]:
    return sorted((tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) for r in df.collect()), key=str)


def test_clusters_equal_brute_force(spark):
    rows = vectors(1, 400, dim=64)
    assert of_clusters(op13_clusters.clustered(frame(spark, rows, SCHEMA, parts=5))) == clusters(rows)


def test_clusters_awkward_rows(spark):
    base = vectors(2, 90, dim=64)
    rows = base + [(k, base[0][1], 1) for k in range(500, 560)]  # copies: ties between equal centroids
    rows += [(7, base[7][1], 0), (None, base[8][1], 0), (900, None, 1), (901, [1.0] * 63, 1), (902, [None] * 64, 1), (903, [float("nan")] * 64, 1), (904, [float("-inf")] * 64, 1), (905, [0.0] * 64, None)]
    df = spark.createDataFrame([(*r, 5, "y") for r in rows], SCHEMA + ", cluster int, v string").repartition(4)
    assert of_clusters(op13_clusters.clustered(df)) == clusters(rows)
    assert of_clusters(op13_clusters.clustered(df.limit(0))) == []
    few = base[:3]
    assert of_clusters(op13_clusters.clustered(frame(spark, few, SCHEMA))) == clusters(few)
    assert of_clusters(op13_clusters.clustered(frame(spark, [(None, base[0][1], 1)], SCHEMA))) == []


def test_annulus_is_exact_and_prunes():
    rng = np.random.default_rng(8)
    scale = rng.choice([1, 40, 400, 3000], size=(500, 1))
    x = (rng.normal(size=(500, 6)) * scale).astype(np.int64)
    c = np.vstack([x[rng.choice(500, 30)], np.array([[3, 4, 0, 0, 0, 0], [0, 0, 3, 4, 0, 0], [0, 5, 0, 0, 0, 0]])])
    for big in (1, 1 << 14):  # beyond 2**22 in integers
        name, best, made = op13_clusters.nearest(x * big, c * big)
        d = ((x[:, None, :] - c[None]) ** 2).sum(axis=2) * big * big
        assert name.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()
        assert made < 0.6 * d.size
    zero = np.zeros((1, 6), np.int64)  # three centroids at one distance: the smallest number
    assert op13_clusters.nearest(zero, c[-3:])[0].tolist() == [0]
    line = np.array([[0, 0], [10, 0]], np.int64)  # ties on the border of the annulus
    assert op13_clusters.nearest(np.array([[5, 0]]), line)[0].tolist() == [0]
    assert op13_clusters.nearest(np.array([[5, 0]]), line[::-1])[0].tolist() == [0]
