"""Quality rules with risk-controlled thresholds, in DataFrame operations only.

Each rule rejects documents whose statistic is above a cutoff.  Nothing else
is fitted to the labels, so all labelled documents are the holdout on which
cutoffs are chosen, so that, in each stratum (band of document
length), a rule falsely rejects more than ``RISK`` of the good documents with
a probability of at most ``DELTA`` over all rules and strata together: from
the loosest cutoff on, the hypothesis "the rule rejects more than RISK of good
documents here" is tested by the exact binomial tail
``P(Bin(n, RISK) <= k) <= DELTA / (rules x strata)`` with k of n good
documents above the cutoff, and the tightest cutoff before the first test that
fails is taken (fixed-sequence testing, so the cutoffs themselves cost no
correction; Bonferroni over rules and strata).  Where already the loosest
cutoff fails, as with few labels, the rule rejects nothing in that stratum: with
these parameters a stratum needs 237 good documents for a first cutoff.

Results: an empty table gives no rows; very long texts are one row like any other; null and empty texts have no words, statistics of 0 and fail the base
rule; labels that are null or other than 1 are not good documents; a document
with several good labels counts once; repeated rows are judged each; columns
other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved
from .op6_decontaminate import runs

#: Share of good documents a rule may reject in a stratum; probability that any rule does worse.
RISK, DELTA = 0.02, 0.1
#: First number of words of each stratum.
BANDS = (0, 100, 1000)
_SPACE = r"[\x20\x09-\x0D]+"
_SYMBOLS = "#*$%&|<>"
#: Cutoffs of each rule, loosest first.
CUTOFFS: dict[str, list[float]] = {
    "symbol_share": [round(1.0 * 0.8**k, 6) for k in range(24)],
    "dup_line_share": [round(0.9 - 0.05 * k, 6) for k in range(15)],
    "repeat_share": [round(0.2 - 0.0125 * k, 6) for k in range(15)],
    "word_length": [round(40 * 0.9**k, 6) for k in range(18)],
}


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def repeat_words(window_hashes: Column, k: int = 5) -> Column:
    """Words in windows of ``k`` that occur twice or more, from the windows' hashes in order."""

    def repeated(hashes: Column) -> Column:
        s = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.transform(F.array(s), _from_sorted)[0]

    def _from_sorted(s: Column) -> Column:
        same = lambda j, d: F.coalesce(F.get(s, j)["h"] == F.get(s, j + d)["h"], F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(j, -1) | same(j, 1))
        starts = F.array_sort(F.transform(twice, lambda j: s[j]["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
        return F.aggregate(starts, zero, lambda a, i: F.struct((i + k).alias("end"), (a["n"] + i + k - F.greatest(a["end"], i)).alias("n")), lambda a: a["n"])

    return F.when(F.size(window_hashes) > F.size(F.array_distinct(window_hashes)), repeated(window_hashes)).otherwise(F.lit(0))


def statistics(docs: DataFrame) -> DataFrame:
    """The base columns and rule statistics of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select("doc_id", text.alias("t"), words(F.col("text")).alias("w"))
    cut = cut.select("doc_id", "t", F.transform("w", lambda x: F.xxhash64(x)).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    cut = cut.select("doc_id", "t", "w", "lines", runs(F.col("w"), 5).alias("h"))
    base = cut.select(
        "doc_id",
        F.size("w").cast("bigint").alias("n_words"),
        _without(F.col("t"), " \t\n\x0b\x0c\r").cast("bigint").alias("word_chars"),
        (F.length("t") - _without(F.col("t"), _SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("h")).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
    )
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    stratum = F.lit(0)
    for k, least in enumerate(BANDS):
        stratum = F.when(F.col("n_words") >= least, k).otherwise(stratum)
    return base.select(
        "*",
        ((F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))).alias("base_failed"),
        stratum.alias("stratum"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("word_chars", "n_words").alias("word_length"),
    )


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """``P(Bin(n, p) <= k)``: terms from 0 up, in logarithms so that nothing underflows."""
    first = F.struct((n * F.log(F.lit(1 - p))).alias("log"), F.exp(n * F.log(F.lit(1 - p))).alias("sum"))

    def step(a: Column, i: Column) -> Column:
        log = a["log"] + F.log((n - i + 1).cast("double") / i) + F.log(F.lit(p / (1 - p)))
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    up = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(up, first, step, lambda a: a["sum"])


def cutoffs(stats: DataFrame, good: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``(stratum, <rule>_cut ...)``: one row for each stratum with good documents, null where a rule may not be used."""
    above = [F.sum((F.col(rule) > c).cast("bigint")).alias(f"{rule}_{k}") for rule, cuts in CUTOFFS.items() for k, c in enumerate(cuts)]
    counts = stats.where(~F.col("base_failed")).join(good.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *above)
    level = delta / (len(CUTOFFS) * len(BANDS))
    out = [F.col("stratum").alias("s")]
    for rule, cuts in CUTOFFS.items():
        # The tail of a count is computed only up to the largest count that can still pass.
        tried = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"{rule}_{k}").alias("k")) for k, c in enumerate(cuts)])
        passed = F.transform(tried, lambda x: F.struct(x["c"].alias("c"), ((x["k"] <= F.col("n") * risk) & (F.when(x["k"] <= F.col("n") * risk, binomial_tail(x["k"], F.col("n"), risk)).otherwise(1.0) <= level)).alias("ok")))
        zero = F.struct(F.lit(None).cast("double").alias("c"), F.lit(True).alias("going"))
        out.append(F.aggregate(passed, zero, lambda a, x: F.struct(F.when(a["going"] & x["ok"], x["c"]).otherwise(a["c"]).alias("c"), (a["going"] & x["ok"]).alias("going")), lambda a: a["c"]).alias(f"{rule}_cut"))
    return counts.select(*out)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document; ``kept`` is the verdict of base rule and thresholds."""
    stats = saved(statistics(docs))
    good = labels.where(F.col("quality") == 1)
    # One row for each of the len(BANDS) strata.
    rules = F.broadcast(cutoffs(stats, good))
    rejected = F.lit(False)
    for rule in CUTOFFS:
        rejected = rejected | F.coalesce(F.col(rule) > F.col(f"{rule}_cut"), F.lit(False))
    return stats.join(rules, stats["stratum"] == rules["s"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept")
    )
