import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from isobar.llm import op1_language, op2_toxicity, op5_quality, queries, stages
from isobar.llm import text as T
from isobar.llm.common import held_out, sample

from .helpers import awkward, docs, frame, prose


def flat(texts):
    return T.flat(pa.array(texts, pa.string()))


# -- language -----------------------------------------------------------------


def brute_cost(counts, langs, order, text, lang):
    """Code length by walking the contexts, one byte after the other."""
    known = {g[-1] for size in counts for (_, g) in counts[size] if size == 1}
    raw, bits = text.encode(), 0.0
    for i, s in enumerate(raw):
        k = order if i >= order else 0
        while True:
            ctx = raw[i - k : i]
            seen = {g[-1]: n for (x, g), n in counts[k + 1].items() if x == lang and g[:-1] == ctx}
            if seen:
                total, kinds = sum(seen.values()), len(seen)
                if s in seen:
                    bits += np.log2((total + kinds) / seen[s])
                    break
                bits += np.log2((total + kinds) / kinds)
            if k == 0:
                bits += 8.0
                break
            k -= 1
    assert known
    return bits


def test_code_lengths_equal_a_walk_through_the_contexts():
    rng = random.Random(0)
    train = {"a": "the cat sat on the mat the cat", "b": "der hund und die katze und der"}
    order, counts = 3, {}
    for size in range(1, order + 2):
        counts[size] = {}
        for lang, t in train.items():
            raw = t.encode()
            for i in range(len(raw) - size + 1):
                counts[size][lang, raw[i : i + size]] = counts[size].get((lang, raw[i : i + size]), 0) + 1
    rows = [(sorted(train).index(lang), size, int.from_bytes(g, "big"), n) for size in counts for (lang, g), n in counts[size].items()]
    ppm = op1_language.Ppm(sorted(train), *(np.array(x) for x in zip(*rows, strict=True)), order)
    texts = ["the hund", "", "x", "und die", "".join(rng.choice("thecatdrunm ") for _ in range(60))]
    got = ppm.lengths(*flat(texts))
    want = [[brute_cost(counts, train, order, t, lang) for lang in sorted(train)] for t in texts]
    assert np.allclose(got, want, atol=1e-3)


def test_tables_of_few_languages_give_the_same_code_lengths():
    rng = np.random.default_rng(3)
    letters = ["abcd", "bcde", "xyzé", "aéz", "cdx"]
    rows = set()
    for k, own in enumerate(letters):
        raw = "".join(rng.choice(list(own), 300)).encode()
        for size in range(1, 5):
            rows |= {(k, size, int.from_bytes(raw[i : i + size], "big")) for i in range(len(raw) - size + 1)}
    lang, size, gram = (np.array(x) for x in zip(*sorted(rows), strict=True))
    n = rng.integers(1, 9, len(lang))
    texts = ["abcabc", "", "zéz q", "xyzzy", "a", "dcba" * 50]
    raw = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    one = op1_language.Ppm(letters, lang, size, gram, n, block=5)
    for block in (1, 2):
        many = op1_language.Ppm(letters, lang, size, gram, n, block=block)
        assert len(many.parts) == -(-5 // block)
        for short in (False, True):
            assert np.allclose(many.lengths(raw, off, short), one.lengths(raw, off, short), rtol=1e-5)
        assert (many.predict(raw, off)[0] == one.predict(raw, off)[0]).all()


def test_first_bytes_have_shorter_contexts():
    counts = [(0, "th", 3), (0, "ht", 1), (1, "ht", 3), (1, "th", 1)]
    rows = [(lang, 2, ord(g[0]) << 8 | ord(g[1]), n) for lang, g, n in counts] + [(lang, 1, ord(c), 4) for lang in (0, 1) for c in "th"]
    ppm = op1_language.Ppm(["a", "b"], *(np.array(x) for x in zip(*rows, strict=True)))
    first = np.log2((4 + 4 + 2) / 4)  # order 0: 8 bytes of 2 kinds
    a, b = (np.log2((n + 1) / n) for n in (3, 1))  # order 1: the only follower
    assert np.allclose(ppm.lengths(*flat(["th"]), short=True), [[first + a, first + b]], atol=1e-3)
    assert [int(x) for x in ppm.predict(*flat(["th", "ht", ""]))[0]] == [0, 1, 0]


def test_language_of_held_out_documents(spark, data):
    got = queries.op1_language_id(spark, data).toPandas()
    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(truth, on="doc_id")
    assert len(got) == len(truth) and got["score"].between(0, 1).all()
    own = both[both["held_out"] & both["lang"].notna()]
    assert (own["lang"] == own["lang_pred"]).mean() > 0.95
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()


def test_language_of_awkward_texts(spark):
    train = frame(spark, [(k, prose(random.Random(k), 50), "en" if k % 2 else "xx", None, None) for k in range(8)])
    df = docs(spark, [*awkward(), "12 34 !?", None]).withColumn("held_out", held_out())
    out = {r["doc_id"]: r for r in op1_language.predict(df, train).collect()}
    assert out[0]["lang_pred"] == out[1]["lang_pred"] == out[len(awkward())]["lang_pred"] == "und" and out[0]["score"] == 0
    assert out[4]["lang_pred"] in ("en", "xx")
    assert {r["lang_pred"] for r in op1_language.predict(df, train.limit(0)).collect()} == {"und"}
    assert op1_language.predict(df.limit(0), train).count() == 0


def test_sample_reads_every_group(spark):
    df = spark.range(30_150).selectExpr("id as doc_id", "if(id < 20100, cast(id div 2 as string), 'large') as lang")
    n = {r["lang"]: r["count"] for r in sample(df, "lang", 300).groupBy("lang").count().collect()}
    assert len(n) == 10_051 and 200 < n.pop("large") < 400 and set(n.values()) == {2}
    assert sample(df, "lang", 300).columns == df.columns


def test_sample_is_bounded_and_stable(spark):
    df = frame(spark, [(k, None, "a" if k % 10 else "b", None, None) for k in range(4000)])
    one, two = sample(df, "lang", 300), sample(df.repartition(7), "lang", 300)
    n = {r["lang"]: r["count"] for r in one.groupBy("lang").count().collect()}
    assert 200 < n["a"] < 400 and 200 < n["b"] <= 400
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(r["doc_id"] for r in two.collect())


# -- quality ------------------------------------------------------------------


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 30, 200).astype(float), rng.random(200)
    knots, value = op5_quality.isotonic(x, y)
    fit = np.interp(x, knots, value)
    assert (np.diff(value) >= -1e-12).all() and fit.mean() == pytest.approx(y.mean())
    for cut in range(1, 30):  # no shift of an upper or lower set improves it
        for part in (x >= cut, x < cut):
            if part.any():
                r = (y - fit)[part].sum()
                assert r <= 1e-9 if part[x >= cut].all() and (part == (x >= cut)).all() else r >= -1e-9


def test_isotonic_rows_weigh_as_many_as_they_stand_for():
    rng = np.random.default_rng(1)
    x, y, times = rng.integers(0, 30, 200).astype(float), rng.random(200), rng.integers(1, 9, 200)
    for a, b in zip(op5_quality.isotonic(x, y, times.astype(float)), op5_quality.isotonic(np.repeat(x, times), np.repeat(y, times)), strict=True):
        np.testing.assert_allclose(a, b)
    # One kind is a millionth of the other: no row is copied for it.
    y = (np.arange(2000) % 2).astype(float)
    knots, value = op5_quality.isotonic(rng.random(2000), y, np.where(y == 1, 1e-3, 1e3))
    assert len(knots) <= 4000 and value[0] < 1e-5


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 4))
    phi = op5_quality.Features(np.zeros(4), np.ones(4), features=20_000, width=2.0)
    z = phi(x)[:, 5:]
    want = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 2.0**2))
    assert np.abs(z @ z.T - want).max() < 0.05


def junk(rng, n):
    return " ".join(prose(rng, 1) + rng.choice(["###", "%%%", "$$$"]) for _ in range(n))


def labelled(spark, n=300):
    rng = random.Random(0)
    texts = [junk(rng, 40) if k % 3 == 0 else prose(rng, rng.randrange(10, 90)) for k in range(n)]
    labels = spark.createDataFrame([(k, 0 if k % 3 == 0 else 1, int(k % 3 == 0)) for k in range(n)] + [(5, None, None), (7, 9, 9)], "doc_id long, quality int, toxic int")
    return docs(spark, texts), labels


def test_quality_scores(spark):
    df, labels = labelled(spark)
    got = op5_quality.score(df, op5_quality.learned(df, labels)).toPandas()
    own = got[got["held_out"]]
    assert ((own["predicted"] == 1) == (own["doc_id"] % 3 != 0)).mean() > 0.97
    assert got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    out = op5_quality.score(docs(spark, awkward()), op5_quality.learned(df, labels)).toPandas()
    assert len(out) == len(awkward()) and out["score"].notna().all()


def test_quality_without_or_with_one_label(spark):
    df, labels = labelled(spark, 30)
    assert {r["score"] for r in op5_quality.score(df, op5_quality.learned(df, labels.limit(0))).collect()} == {0.5}
    assert {r["score"] for r in op5_quality.score(df, op5_quality.learned(df, labels.where("quality = 0"))).collect()} == {0.0}
    assert op5_quality.score(df.limit(0), op5_quality.learned(df, labels)).count() == 0


def test_quality_stage_keeps_columns_and_good_rows(spark, data):
    df = spark.read.parquet(f"{data}/documents.parquet")
    out = stages.quality(spark, df, data)
    assert out.columns == df.columns
    labels = spark.read.parquet(f"{data}/labels.parquet")
    assert out.join(labels.where("quality = 1"), "doc_id").count() >= 0.95 * df.join(labels.where("quality = 1"), "doc_id").count()


# -- toxicity -----------------------------------------------------------------


def test_thresholds_are_ordered_and_the_fit_is_a_minimum():
    rng = np.random.default_rng(0)
    n, width = 600, 5
    x = rng.random((n, width)) < 0.4
    s = x @ np.array([2.0, 1.0, 0.0, -1.0, 0.5])
    grade = np.searchsorted([0.5, 1.5, 2.5], s + rng.logistic(size=n))
    row, col = np.nonzero(x)
    w, theta = op2_toxicity.fit_ordinal(row, col, grade, width, ridge=0.01, steps=1500)
    assert (np.diff(theta) > 0).all() and np.abs(w - [2, 1, 0, -1, 0.5]).max() < 0.5

    def loss(w, theta):
        t = np.r_[-50, theta, 50]
        z = x @ w
        p = 1 / (1 + np.exp(-(t[grade + 1] - z))) - 1 / (1 + np.exp(-(t[grade] - z)))
        return -np.log(p).sum() + 0.005 * (w**2).sum()

    best = loss(w, theta)
    for k in range(width):
        for e in (-0.02, 0.02):
            assert loss(w + e * np.eye(width)[k], theta) > best - 1e-3


def test_toxic_documents_are_found(spark):
    rng = random.Random(3)
    bad = ["vile", "nasty", "foul", "rotten"]
    texts = []
    for k in range(400):
        w = prose(rng, 40, 300).split()
        if k % 4 == 0:
            for _ in range(1 + k // 4 % 4):
                w[rng.randrange(40)] = rng.choice(bad)
        texts.append(" ".join(w))
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)], "doc_id long, quality int, toxic int")
    df = docs(spark, texts)
    model = op2_toxicity.learned(df, labels)
    got = op2_toxicity.score(df, model).toPandas()
    own = got[got["held_out"]]
    assert ((own["predicted"] == 1) == (own["doc_id"] % 4 == 0)).mean() > 0.95
    assert got["severity"].between(0, op2_toxicity.GRADES - 1).all() and got["grade"].between(0, op2_toxicity.GRADES - 1).all()
    out = op2_toxicity.score(docs(spark, awkward()), model).toPandas()
    assert len(out) == len(awkward()) and out["severity"].notna().all()
    assert op2_toxicity.score(df.limit(0), model).count() == 0
    none = op2_toxicity.learned(df, labels.limit(0))
    assert op2_toxicity.score(df, none).toPandas()["severity"].max() < 1e-6


def test_weights_count_texts_several_times():
    rng = np.random.default_rng(1)
    x, grade = rng.random((300, 3)) < 0.4, rng.integers(0, 4, 300)
    times = np.where(grade == 0, 5, 1)
    row, col = np.nonzero(x)
    more = np.repeat(np.arange(300), times)
    want = op2_toxicity.fit_ordinal(*np.nonzero(x[more]), grade[more], 3)
    got = op2_toxicity.fit_ordinal(row, col, grade, 3, weight=times)
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(got, want, strict=True))


def test_severity_does_not_depend_on_the_size_of_the_sample(spark):
    rng = random.Random(5)
    texts = []
    for k in range(2000):
        w = prose(rng, 20, 30).split()
        if rng.random() < (0.8 if k % 10 == 0 else 0.2):
            w[rng.randrange(20)] = "vile"
        texts.append(" ".join(w))
    labels = spark.createDataFrame([(k, 1, int(k % 10 == 0)) for k in range(2000)], "doc_id long, quality int, toxic int")
    df = docs(spark, texts)
    probe = flat(["", "so vile"])
    whole, part = (op2_toxicity.learned(df, labels, n).above(*probe)[:, 0] for n in (3000, 120))
    assert np.abs(whole - part).max() < 0.1


def balanced(truth, guess):
    """Mean of the shares of each label that are met: one half for any constant."""
    return np.mean([(guess[truth == y] == y).mean() for y in (0, 1)])


def test_held_out_accuracy(spark, data):
    d = data.replace("0.001", "0.1")  # 97 toxic and 122 bad documents are held out
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    for query, label, least in ((queries.op2_toxicity_severity, "toxic", 0.9), (queries.op5_quality_score, "quality", 0.9)):
        got = query(spark, d).toPandas()
        assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
        own = got[got["held_out"]].merge(labels, on="doc_id")
        assert {0, 1} <= set(own[label]) and balanced(own[label], own["predicted"]) > least


def test_scores_equal_ridge_and_isotonic_by_brute_force(spark, data):
    """Statistics, normal equations and calibration once more, in one piece."""
    df, table = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    texts = df.selectExpr("doc_id", "text", "pmod(xxhash64('fold', doc_id), 4) as fold").toPandas().merge(table.toPandas(), on="doc_id", how="left").sort_values("doc_id").reset_index(drop=True)
    x = np.vstack([op5_quality.statistics(*flat([t])) for t in texts["text"]])
    learn = ((texts["quality"] >= 0) & texts["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 > 0)).to_numpy()
    y, fold = texts["quality"].to_numpy()[learn], texts["fold"].to_numpy()[learn]
    own = x[learn]
    phi = op5_quality.Features(own.mean(0), own.std(0))
    balance = {v: len(y) / (2 * (y == v).sum()) for v in (0, 1)}
    w = np.sqrt([balance[v] for v in y])[fold > 0]
    z = phi(own[fold > 0]) * w[:, None]
    root = np.sqrt(op5_quality.RIDGE * len(y)) * np.eye(z.shape[1])
    weights = np.linalg.lstsq(np.vstack([z, root]), np.r_[y[fold > 0] * w, np.zeros(z.shape[1])], rcond=None)[0]
    rest, target = phi(own[fold == 0]) @ weights, y[fold == 0]
    order = np.argsort(rest)
    rest, target = rest[order], target[order].astype(float)
    # The monotone fit as the largest mean over beginnings of the smallest mean over ends.
    mean = lambda a, b: target[a : b + 1].mean()
    value = np.array([max(min(mean(a, b) for b in range(k, len(target))) for a in range(k + 1)) for k in range(len(target))])
    want = np.interp(phi(x) @ weights, rest, value)
    got = queries.op5_quality_score(spark, data).toPandas().sort_values("doc_id")["score"].to_numpy()
    assert len(np.unique(rest)) == len(rest) and np.abs(got - want).max() < 1e-3
