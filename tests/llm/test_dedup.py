import hashlib
import random
import re

import numpy as np
import pytest

from isobar.llm import op3_minhash, op4_suffix, op8_anchors, stages

from .helpers import awkward, docs, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def collected(df, key="doc_id"):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0))


# -- MinHash ------------------------------------------------------------------


def components(texts, k, percent):
    sets = []
    for t in texts:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))]


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, k, percent):
    rng = random.Random(3)
    texts = awkward()
    for _ in range(6):  # chains of near copies around the threshold
        w = prose(rng, 120).split()
        for _ in range(10):
            texts.append(" ".join(w))
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
    got = collected(op3_minhash.near_duplicates(docs(spark, texts), k, percent))
    assert got == components(texts, k, percent)


def test_many_blocks_give_the_same_components(spark, monkeypatch):
    monkeypatch.setattr(op3_minhash, "BLOCK_NODES", 8)
    monkeypatch.setattr(op3_minhash, "PIVOTS", 3)
    rng = random.Random(5)
    base = prose(rng, 150).split()
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9999)}"
        texts.append(" ".join(w))
    got = collected(op3_minhash.near_duplicates(docs(spark, texts), 3, 85))
    assert got == components(texts, 3, 85)


def test_repeated_ids_null_ids_and_empty_tables(spark):
    rng = random.Random(1)
    a, b, c = (prose(rng, 40) for _ in range(3))
    rows = [(5, a), (5, a), (None, a), (None, None), (7, b), (7, c), (9, c), (11, "")]
    df = frame(spark, [(i, t, None, None, None) for i, t in rows])
    got = collected(op3_minhash.near_duplicates(df, 3, 85))
    assert [tuple(r) for r in got if r[0] is None] == [(None, 0, None, True), (None, 38, None, True)]
    assert [(r[0], r[2], r[3]) for r in got if r[0] is not None] == [(5, 5, True), (5, 5, True), (7, 7, True), (7, 7, True), (9, 7, False), (11, 11, True)]
    assert op3_minhash.near_duplicates(df.limit(0), 3, 85).count() == 0


def test_stage_keeps_one_of_each_group_and_all_columns(spark, data):
    df = docs(spark, awkward())
    out = stages.near_dedup(spark, df.unionByName(df.where("doc_id in (6, 20)")), data)
    assert out.columns == df.columns
    kept = sorted(r["doc_id"] for r in out.collect())
    assert kept == [i for i, _, _, k in components(awkward(), 5, 80) if k]


def test_stage_keeps_unlike_texts_of_one_id(spark, data):
    rng = random.Random(8)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    near = a + " more"
    rows = [(3, a), (7, b), (7, c), (7, near), (7, b), (9, c), (9, d), (None, a), (None, a), (4, None), (4, None), (5, "")]
    out = stages.near_dedup(spark, frame(spark, [(i, t, None, None, k) for k, (i, t) in enumerate(rows)]), data)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    of = lambda i: [t for j, t in got if j == i]
    assert of(3) == [a] and of(None) == [a, a] and of(4) == [None] and of(5) == [""]
    assert sorted(t for _, t in got if t in (b, c, d)) == sorted([b, c, d])
    assert near not in of(7) and d in of(9)
    again = stages.near_dedup(spark, frame(spark, [(i, t, None, None, k) for k, (i, t) in enumerate(rows)], parts=1), data)
    assert sorted(map(str, again.collect())) == sorted(map(str, out.collect()))


def test_stages_take_empty_tables(spark, data):
    df = docs(spark, awkward()).limit(0)
    for stage in (stages.quality, stages.near_dedup, stages.substring_dedup, stages.decontamination):
        out = stage(spark, df, data)
        assert out.columns == df.columns and out.count() == 0
    assert stages.tokens(spark, df, data).count() == 0


# -- bytes --------------------------------------------------------------------


def removed_bytes(texts, length=200):
    raw = [(t or "").encode() for t in texts]
    where = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - length + 1):
            where.setdefault(b[i : i + length], []).append((d, i))
    gone = [np.zeros(len(b), dtype=bool) for b in raw]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = True
    out = []
    for d, (b, g) in enumerate(zip(raw, gone, strict=True)):
        kept = bytes(np.frombuffer(b, np.uint8)[~g])
        spans = int((g & ~np.r_[False, g[:-1]]).sum()) if len(g) else 0
        out.append((d, len(b), int(g.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"chunk_bytes": 1500}, {"chunk_bytes": 1500, "hot_kinds": 1}])
def test_suffix_dedup_equals_brute_force(spark, options):
    rng = random.Random(11)
    texts = awkward()
    shared = prose(rng, 70)
    for _ in range(25):  # one passage between differing neighbours
        texts.append(prose(rng, 20) + shared[rng.randrange(20) : 300 + rng.randrange(60)] + prose(rng, 20))
    texts += ["b" * 204, "c" * 199, "".join(rng.choice("ab") for _ in range(260)) * 3]
    assert collected(op4_suffix.digests(docs(spark, texts), **options)) == removed_bytes(texts)


def earlier(text, i, length):
    """Longest match of the suffix at i that starts earlier."""
    return max([0] + [next((k for k in range(length) if text[i + k] != text[j + k]), length) for j in range(i)])


@pytest.mark.parametrize(("text", "length"), [(b"xabcabcabcy" * 3, 5), (b"ab" * 20 + b"aab" * 9, 8), (b"q" * 40, 16), (bytes(random.Random(3).choices(b"ab\x00", k=150)), 8)])
def test_longest_previous_factors(text, length):
    raw = np.frombuffer(text, dtype=np.uint8)
    at = np.arange(len(raw) - length + 1)
    head = op4_suffix.heads(raw, at, length)
    assert [text[i : i + length] for i in op4_suffix.suffix_order(head)] == sorted(text[i : i + length] for i in at)
    got, place = op4_suffix.longest_previous_factors(head)
    assert got.tolist() == [earlier(text, i, length) for i in at]
    for i, n, j in zip(at, got, place, strict=True):
        assert (n == 0 or j < i) and (j < 0 or text[i : i + n] == text[j : j + n])
    alike = [sum(text[j : j + length] == text[i : i + length] for j in at) > 1 for i in at]
    assert op4_suffix.repeated_starts(head).tolist() == alike


def test_second_copies_are_factors():
    text = b"abcdefgh" + b"abcdxyzw" + b"12345678"
    at = np.array([0, 8, 16, 1])
    head = op4_suffix.heads(np.frombuffer(text + text, np.uint8), at, 8)
    twice = np.array([True, False, True, False])
    length, place = op4_suffix.longest_previous_factors(head, twice)
    assert length.tolist() == [0, 4, 0, 0, 8, 8] and place[4:].tolist() == [0, 2]
    assert op4_suffix.repeated_starts(head, twice).tolist() == twice.tolist()


def test_hot_keys_join_as_others(spark, monkeypatch):
    from isobar.llm import common

    rows = spark.range(300).selectExpr("id", "if(id < 200, 7, id % 5) as k")
    once = rows.groupBy("k").count().withColumnRenamed("count", "n")
    want = sorted(tuple(r) for r in common.joined(rows, once, ["k"], "n").collect())
    monkeypatch.setattr(common, "HOT_ROWS", 50)
    out = common.joined(rows, once, ["k"], "n")
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) == 300
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def test_suffix_dedup_of_an_empty_table(spark):
    assert op4_suffix.digests(docs(spark, ["x"]).limit(0)).count() == 0


# -- words --------------------------------------------------------------------


def kept_words(rows, k=20):
    seen, out = set(), []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            if key in seen:
                gone[s : s + k] = [True] * k
            seen.add(key)
        out.append((i, w, gone))
    return out


@pytest.mark.parametrize("chunk_bytes", [1 << 20, 900])
def test_anchor_dedup_equals_brute_force(spark, chunk_bytes):
    rng = random.Random(2)
    texts = awkward()
    shared = prose(rng, 45).split()
    for _ in range(30):
        a = rng.randrange(20)
        texts.append(prose(rng, rng.randrange(25)) + " " + " ".join(shared[a : a + 19 + rng.randrange(8)]) + "\n" + prose(rng, rng.randrange(30)))
    order = list(enumerate(texts))
    want = [(i, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for i, w, g in kept_words(order)]
    rng.shuffle(order)  # ids and places differ
    df = frame(spark, [(i, t, None, None, None) for i, t in order])
    assert collected(op8_anchors.digests(df, chunk_bytes)) == want


def test_a_passage_in_every_chunk(spark, monkeypatch):
    from isobar.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 10)  # its keys are joined by broadcast
    rng = random.Random(6)
    passage, texts = prose(rng, 50), []
    for _ in range(60):
        texts.append(prose(rng, 30) + " " + passage + " " + prose(rng, 30))
    want = [(i, len(w), sum(g), hashlib.sha256(" ".join(x for x, y in zip(w, g, strict=True) if not y).encode()).hexdigest()) for i, w, g in kept_words(list(enumerate(texts)))]
    assert collected(op8_anchors.digests(docs(spark, texts), 400)) == want
    assert collected(op4_suffix.digests(docs(spark, texts), 400)) == removed_bytes(texts)


def test_anchor_dedup_of_an_empty_table(spark):
    df = docs(spark, ["x"]).limit(0)
    assert op8_anchors.digests(df).count() == 0
    assert op8_anchors.deduplicated(df).count() == 0 and op8_anchors.deduplicated(df).columns == df.columns


def test_difference_cover_meets_every_shift():
    cover = set(op8_anchors.COVER)
    for d in range(op8_anchors.PERIOD):
        assert any((c + d) % op8_anchors.PERIOD in cover for c in cover)


def test_stage_takes_passages_out_and_keeps_the_rest(spark, data):
    rng = random.Random(4)
    passage = prose(rng, 60)
    texts = [passage, "head of it\n" + passage + "\ntail of it", None, "", "clean  text\twith\n\nblanks ", passage]
    df = docs(spark, texts)
    out = {r["doc_id"]: r for r in stages.substring_dedup(spark, df, data).collect()}
    assert stages.substring_dedup(spark, df, data).columns == df.columns
    assert [out[k]["text"] for k in range(6)] == [passage, "head of it\ntail of it", None, "", "clean  text\twith\n\nblanks ", ""]
    assert out[1]["n_chars"] == len("head of it\ntail of it") and out[2]["n_chars"] is None


def test_null_and_repeated_ids(spark):
    rng = random.Random(9)
    a, b = prose(rng, 40), prose(rng, 60)
    df = frame(spark, [(None, a, None, None, None), (4, a, None, None, None), (4, a, None, None, None), (None, None, None, None, None), (6, b, None, None, None)], parts=1)
    words = sorted((r["doc_id"] or -1, r["n_removed"]) for r in op8_anchors.digests(df).collect())
    assert words == [(-1, 0), (-1, 0), (4, 40), (4, 40), (6, 0)]
    size = len(a.encode())
    got = sorted((r["doc_id"] or -1, r["n_removed"]) for r in op4_suffix.digests(df).collect())
    assert got == sorted([(-1, size), (-1, 0), (4, size), (4, size), (6, 0)])


def test_stages_pass_on_columns_of_any_name(spark, data):
    from pyspark.sql import functions as F

    df = docs(spark, awkward())
    names = ["chunk", "rest", "ids", "key", "d", "r", "rid", "y", "score", "fold", "n", "component", "node", "a b", "struct.x"]
    for n in names:
        df = df.withColumn(n, F.struct(F.col("doc_id").alias("doc_id"), F.lit(n).alias("text")))
    for stage in (stages.quality, stages.near_dedup, stages.substring_dedup, stages.decontamination):
        out = stage(spark, df, data)
        assert out.columns == df.columns
        rows = out.select("doc_id", *[F.col(f"`{n}`.doc_id").alias(f"c{k}") for k, n in enumerate(names)]).collect()
        assert rows and all(v == r["doc_id"] for r in rows for v in r)


def test_factors_from_what_neighbours_share():
    """Each suffix's longest earlier match from the prefixes of neighbours in the order, against all pairs."""
    rng = np.random.default_rng(3)
    for width in (5, 8, 16):
        head = np.ascontiguousarray(rng.integers(0, 2, (20, width)).astype(np.uint8)[rng.integers(0, 20, 40)])
        twice = rng.random(40) < 0.3
        every = np.vstack([head, head[twice]])
        length, place = op4_suffix.longest_previous_factors(head, twice)
        for k in range(len(every)):
            same = [int((np.r_[every[j] != every[k], True]).argmax()) for j in range(k)]
            assert length[k] == max(same, default=0) and (not length[k] or same[place[k]] == length[k])
    ordered = np.array([[1, 1], [1, 2], [2, 2]], dtype=np.uint8)
    assert op4_suffix.common_prefix(ordered).tolist() == [1, 0]
