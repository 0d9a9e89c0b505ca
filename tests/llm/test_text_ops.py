import hashlib
import html as html_lib
import html.parser as html_parser
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from isobar.llm import op6_decontaminate, op7_tokens, op9_html, op10_rules, queries, stages
from isobar.llm.common import saved

from .helpers import awkward, docs, frame, prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")

# -- tokens -------------------------------------------------------------------


@pytest.fixture(scope="module")
def both():
    return op7_tokens.Model(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_tokens_equal_the_library(both):
    mine, lib = both
    rng = random.Random(1)
    texts = [*awkward(), "  a", "a  ", "▁x", "<s> </s> <0x0A> <unk>", "𐍈" * 20, "\u0000a", "a" * 3000, "ﬁ Å １", *[" " * k for k in range(1, 70)], *[" " * k + "ab" for k in range(1, 40)]]
    texts += ["".join(rng.choice("ab éthe ing▁\n\t 日本語🙂ﬁ") for _ in range(rng.randrange(200))) for _ in range(600)]
    ids, edges = mine.encode(texts)
    decoded = mine.decode(ids, edges)
    for k, t in enumerate(texts):
        want = lib.encode(t or "", add_bos=True, add_eos=True)
        assert ids[edges[k] : edges[k + 1]].tolist() == want, repr(t)
        assert decoded[k].decode() == lib.decode(want) == (t or "").replace("▁", " ")


def test_long_words_equal_the_library(both, monkeypatch):
    mine, lib = both
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(200_000)), "a" * 20_000, "ab" * 9_000, "Zm9v" + "".join(rng.choice("ABCabcxyz0189+/") for _ in range(30_000)), "日本語の" * 3_000, " " * 5_000, "x" + "=" * 7_000]
    texts = [" ".join(words), *words]
    began = time.time()
    ids, edges = mine.encode(texts)
    assert time.time() - began < 30
    decoded = mine.decode(ids, edges)
    for k, t in enumerate(texts):
        want = lib.encode(t, add_bos=True, add_eos=True)
        assert ids[edges[k] : edges[k + 1]].tolist() == want and decoded[k].decode() == lib.decode(want)
    monkeypatch.setattr(op7_tokens, "LONG", 2)  # short words too
    fresh = op7_tokens.Model(MODEL)
    for t in (t for t in awkward() if t):
        assert fresh.encode([t])[0].tolist() == lib.encode(t, add_bos=True, add_eos=True)


def test_any_ids_decode_as_in_the_library(both):
    mine, lib = both
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice([3 + rng.randrange(256), rng.randrange(3, 32_000)]) for _ in range(rng.randrange(9))]
        assert mine.decode(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))[0].decode() == lib.decode(ids)


def test_words_are_forgotten_and_learned_again(both, monkeypatch):
    monkeypatch.setattr(op7_tokens, "CACHE_WORDS", 10)
    mine, lib = op7_tokens.Model(MODEL), both[1]
    for k in range(5):
        t = prose(random.Random(k), 30)
        ids, edges = mine.encode([t])
        assert ids.tolist() == lib.encode(t, add_bos=True, add_eos=True)


def test_token_query(spark, both):
    df = docs(spark, awkward())
    got = {r["doc_id"]: r for r in op7_tokens.digests(df, MODEL).collect()}
    for k, t in enumerate(awkward()):
        want = both[1].encode(t or "", add_bos=True, add_eos=True)
        assert got[k]["n_tokens"] == len(want)
        assert got[k]["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
        assert got[k]["decoded_sha256"] == hashlib.sha256(both[1].decode(want).encode()).hexdigest()
    assert op7_tokens.digests(df.limit(0), MODEL).count() == 0
    assert {r["doc_id"]: r["ids"] for r in op7_tokens.encode(df, MODEL).collect()}[5] == both[1].encode("Two words", add_bos=True, add_eos=True)


# -- pages --------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/">Home</a></li></ul></nav><!-- x --><div class="ad">Buy now</div>%s<footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""), ("", ""), ("   ", ""), ("just text", "just text"),
        (PAGE % "<article><h1>A &amp; B</h1><p>One\n  two<br>three</p><p><b>Four<p>Five &eacute;</article>", "A & B\nOne two three\nFour\nFive é"),
        (PAGE % "<main><p>x</p><form><p>name</p><input></form><aside>side</aside><p>y</p></main>", "x\ny"),
        (PAGE % "<article><p>Body</p><section class='comments'><p>First!</p></section></article><div id='cookie-notice'>ok?</div>", "Body"),
        (PAGE % "", ""),
        ("<div id=menu><ul><li><a>Home</a><li><a>About</a></ul></div><div><h1>T</h1><p>Long text of the page.<p>More of it</div><div class=sidebar>s</div>", "T\nLong text of the page.\nMore of it"),
        ("<article><p>cut off in the mid", "cut off in the mid"), ("<article><p>whole</p><p>a <b", "whole\na"), ("<p>1 < 2 & 3</p>", "1 < 2 & 3"),
        ("<article><header><h1>H</h1></header><p>text</p></article></div></div>", "H\ntext"),
        ("<noscript><p>no</p></noscript><p>yes</p><select><option>o</select><textarea>t</textarea>", "yes"),
    ],
)
def test_pages(html, want):
    assert op9_html.extract(html) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<article><h1>Title</h1><p>Lead</p><ul class=share><li>a<li>b<li>c<li>d</ul><p>%s</p></article>", "Title\nLead\n%s"),
        ("<main><p>%s</p><form><p>a<p>b<p>c<p>d</form><p>End</p></main>", "%s\nEnd"),
        ("<div><p>%s</p><div class=ad><p>a<p>b<p>c<p>d</div><p>End</p></div>", "%s\nEnd"),
        ("<div><p>%s</p><p><a href=x>see also this</a></p><p>End</p></div>", "%s\nsee also this\nEnd"),
        ("<div><p><a href=x>Home</a><p><a href=x>News</a><p><a href=x>Shop</a><p>%s</p></div>", "%s"),
    ],
)
def test_short_lines_of_the_article_are_kept(html, want):
    body = "body " * 400
    assert op9_html.extract(html % body) == want % body.strip()


LONG = "Words of the article that go on for a good while, so that it is long enough to be one. " * 3


@pytest.mark.parametrize(
    ("html", "want"),
    [
        # No marked article, names that only look like hints, long gaps of adverts, comments, classes that cover the page.
        ('<body class="single no-sidebar"><div class="ad-free content"><h1>T</h1><p class="share-price">%s</p></div></body>', "T\n%s"),
        ('<article class="sponsored"><p>%s</p><div class="ad-free content"><p>x</p></div></article>', "%s\nx"),
        ("<article><p>%s</p>" + '<div class="ad">Buy now</div>' * 5 + "<p>Short closing.</p></article><div>Else</div>", "%s\nShort closing."),
        ("<div><h1>T</h1><p>%s</p>" + '<div class="ad-container">Buy now</div>' * 9 + "<p>Short closing.</p></div>", "T\n%s\nShort closing."),
        ('<body><div class="comments"><article><p>first</p></article></div><article><p>%s</p><article class="comment"><p>no</p></article></article>', "%s"),
        ('<div class="sidebar"><p>%s</p></div>', "%s"),
        ("<div id=cookie-notice>We use cookies on this page, do you agree with them?</div><nav><p>a<p>b<p>c</nav><div><p>%s</p></div><footer><p>a<p>b<p>c</footer><div>imprint</div>", "%s"),
        # Sums decide: a tag's weight is a small factor, and what lies between two stretches of text is text.
        ("<article><p>x</p></article><div>%s</div>", "%s"),
        ("<article><p>%s</p></article><div>An unmarked aside of some words, not a third of it.</div>", "%s"),
        ("<article><p>%s</p></article><p>between</p><article><p>%s</p></article><div>after</div>", "%s\nbetween\n%s"),
        ("<main><ul><li><a href=x>Teaser one</a> more<li><a href=x>Teaser two</a> more</ul></main><div><h1>T</h1><p>%s</p></div>", "T\n%s"),
        ("<div><h1>T</h1><div><div><p>%s</p></div><p>deep</p></div></div><div>Imprint</div>", "T\n%s\ndeep"),
        ("<div><div>T</div><div>%s</div><div>end</div></div><div>x</div>", "T\n%s\nend"),
        # Names that may be an article's: by heading, length and links.
        ('<article><div class="article-header banner"><h1>T</h1></div><p>%s</p><section class="related"><h2>Related literature</h2><p>A.</p></section></article>', "T\n%s\nRelated literature\nA."),
        ('<article><p>%s</p><section class="related"><p>Other stories</p><p><a href=x>One of them</a></p></section><div class="notice">Sale</div></article>', "%s"),
        ('<article><p>%s</p><p>x <math><mi>a</mi></math> y</p></article><section id="discussion"><p>First!</p></section><div class="outbrain">More</div>', "%s\nx a y"),
    ],
)
def test_windows_decide_on_pages_of_all_kinds(html, want):
    text = LONG.strip()
    assert op9_html.extract(html.replace("%s", text)) == want.replace("%s", text)


def test_surge_and_dive():
    w = np.array([0, 0, 0, 40, 0, 60, 0, 0, 0, 0, 5, 0])
    assert op9_html.span(w) == (3, 6) and op9_html.span(w, 0.05) == (3, 11)
    assert op9_html.span(np.array([], dtype=np.int64)) == op9_html.span(np.array([0, 0])) == (0, 0) and op9_html.span(np.array([3])) == (0, 1)


def windows_by_hand(w: list[int], share: float) -> tuple[int, int]:
    """First and last line of text by sums of three lines, walked one by one."""
    sums = [sum(w[max(0, i - 2) : i + 1]) for i in range(len(w) + 2)]
    found, k = [], 0
    while k < len(sums):
        end = k
        while end < len(sums) and sums[end] > 0:
            end += 1
        if end > k and max(sums[k:end]) >= share * max(sums):
            found.append((k, min(end - 2, len(w))))
        k = max(end, k + 1)
    return (found[0][0], found[-1][1]) if found else (0, 0)


def test_spans_equal_a_walk_over_windows():
    rng = random.Random(4)
    for _ in range(400):
        w = [rng.choice([0, 0, 0, 1, 7, 90]) for _ in range(rng.randrange(1, 30))]
        share = rng.choice([0.001, 0.1, 1 / 3, 1])
        assert op9_html.span(np.array(w), share) == windows_by_hand(w, share)


class Slots(html_parser.HTMLParser):
    """Lines of the fixtures' template with neutral names: text, code points of links, blocks around it."""

    def __init__(self):
        super().__init__()
        self.out, self.buf, self.links, self.link, self.open, self.number, self.children = [], "", 0, 0, [0], 0, [0]

    def flush(self):
        if text := " ".join(self.buf.split()):
            self.out.append((text, self.links, tuple(self.open)))
        self.buf, self.links = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = 1
        if tag == "br":
            self.buf += " "
        if tag in ("p", "h1", "li", "div", "ul", "body"):
            self.flush()
        if tag in ("div", "ul"):
            self.number += 1
            self.children.append(0)
            self.children[self.open[-1]] += 1
            self.open.append(self.number)
        elif tag in ("p", "h1", "li"):
            self.children[self.open[-1]] += 1

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = 0
        if tag in ("p", "h1", "li", "div", "ul", "body"):
            self.flush()
        if tag in ("div", "ul"):
            self.open.pop()

    def handle_data(self, data):
        self.buf += data
        self.links += len(data) * self.link


def by_windows(page: str) -> str:
    p = Slots()
    p.feed(re.sub(r"<(style|script|title)>.*?</\1>|<[^>]*$", "", page, flags=re.S))
    p.flush()
    homes = [c[:-1] if len(c) > 1 and not p.children[c[-1]] else c for _, _, c in p.out]
    w, at = [], []
    for k, (text, links, _) in enumerate(p.out):
        if k:
            a, b = homes[k - 1], homes[k]
            inner = (a[: len(b)] == b and len(b) > 1) or (b[: len(a)] == a and len(a) > 1)
            w += [] if a == b or inner else [0, 0, 0]
        at.append(len(w))
        w.append(0 if 2 * links > len(text) else len(text) - links)
    first, last = windows_by_hand(w, 1 / 3)
    return "\n".join(t for (t, _, _), k in zip(p.out, at, strict=True) if first <= k < last)


def test_windows_decide_without_any_name(spark, data):
    """Element and class names made neutral: the query is the walk over windows, and that finds nearly all articles."""
    pages = spark.read.parquet(f"{data.replace('0.001', '0.01')}/pages.parquet").toPandas()
    right = 0
    for html in pages["html"]:
        bare = re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", re.sub(r' class="[^"]*"', "", html))
        assert op9_html.extract(bare) == by_windows(bare)
        right += op9_html.extract(bare) == op9_html.extract(html) == op9_html.extract(re.sub(r"<(/?)article\b", r"<\1div", html))
    assert right >= 0.9 * len(pages)


def test_stray_and_deep_tags_take_no_time():
    began = time.time()
    for html in ("<div>" * 100_000 + "</p>" * 100_000 + "x", "</p></div>" * 100_000, "<div>" * 50_000 + "</section><p>x</p>" * 50_000, "<div>a<p>b</i></span></section>" * 30_000):
        op9_html.extract(html)
    assert time.time() - began < 20


def test_awkward_tables_of_pages(spark):
    html = "<article><p>" + "long " * 300_000 + "</p></article>"
    df = spark.createDataFrame([(1, "u", html, "x", 3)], "page_id long, url string, html string, text string, n_chars int")
    out = op9_html.extract_pages(df).collect()
    assert out[0]["n_chars"] == 5 * 300_000 - 1 and out[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert op9_html.extract_pages(df.limit(0)).count() == 0


def test_page_query(spark, data):
    got = queries.op9_html_text(spark, data).toPandas()
    pages = spark.read.parquet(f"{data}/pages.parquet").toPandas().set_index("page_id")
    assert len(got) == len(pages) and (got["n_chars"] == got["text"].str.len()).all()
    for r in got.itertuples():  # the pages' own template, read backwards
        article = re.search(r"<article>(.*?)(?:</article>|$)", pages.loc[r.page_id, "html"], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html_lib.unescape(re.sub(r"<(?!br)[^>]*(?:>|$)", "", x).replace("<br>", " "))).strip() for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(x for x in blocks if x)
    rows = [(1, "u", None), (1, "u", "<p>a</p>"), (None, None, "<p>b</p>")]
    out = op9_html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["text"] for r in out) == ["", "a", "b"]


# -- decontamination ----------------------------------------------------------

_W = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return _W.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def contaminated(texts, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for s in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(i))
    out = []
    for d, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in windows}:
            for s in range(len(w) - n + 1):
                if own := windows.get(tuple(w[s : s + n])):
                    hit.update(range(s, s + n))
                    found |= own
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_hits_equal_brute_force(spark):
    rng = random.Random(8)
    items = [(k, prose(rng, rng.choice([3, 9, 10, 11, 25, 40]))) for k in range(30)] + [(30, None), (31, "..."), (32, "only"), (2, None), (100, "A-b c,D e f g h i j k l")]
    items += [items[4], (40, items[4][1])]
    texts = awkward() + ["a b C d e F g h i j", "x a b c d e f g h i j k l y", "only"]
    for _ in range(40):
        w = prose(rng, 60).split()
        other = (rng.choice(items)[1] or "none").split()
        a = rng.randrange(len(other))
        w[20:20] = other[a : a + rng.randrange(4, 30)]
        texts.append(" ".join(w).upper() if rng.random() < 0.3 else "; ".join(w))
    bench = frame(spark, items, "item_id long, text string")
    df = docs(spark, texts)
    got = sorted(tuple(r) for r in op6_decontaminate.report(df.unionByName(df.where("doc_id = 6")), bench).collect())
    want = contaminated(texts, items)
    assert got == sorted([*want, want[6]])
    kept = sorted(r["doc_id"] for r in op6_decontaminate.clean(df, bench).collect())
    assert kept == [d for d, *_, hit in want if not hit] and op6_decontaminate.clean(df, bench).columns == df.columns


def test_empty_benchmark_and_empty_documents(spark):
    bench = frame(spark, [(1, prose(random.Random(0), 20))], "item_id long, text string")
    df = docs(spark, awkward())
    none = op6_decontaminate.report(df, bench.limit(0)).toPandas()
    assert len(none) == len(awkward()) and not none["contaminated"].any()
    assert op6_decontaminate.report(df.limit(0), bench).count() == 0


def test_a_window_of_many_items_in_many_places(spark):
    line = prose(random.Random(3), 10)
    bench = frame(spark, [(k, line) for k in range(300)], "item_id long, text string")
    texts = ["x " + (line + " ") * 400, line, "y"]
    got = sorted(tuple(r) for r in op6_decontaminate.report(docs(spark, texts), bench).collect())
    assert got == contaminated(texts, [(k, line) for k in range(300)])


def test_large_benchmarks_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(op6_decontaminate, "BROADCAST_ROWS", 0)
    text = prose(random.Random(0), 30)
    out = op6_decontaminate.report(docs(spark, ["x " + text, "y"]), frame(spark, [(1, text)], "item_id long, text string"))
    assert [r["n_hit"] for r in out.orderBy("doc_id").collect()] == [30, 0]


def test_sql_of_decontamination(spark, data):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = queries.op6_decontaminate_report(spark, data).toPandas(), c.execute(op6_decontaminate.SQL).df()
    pd.testing.assert_frame_equal(got.sort_values("doc_id").reset_index(drop=True), want.sort_values("doc_id").reset_index(drop=True), check_dtype=False)


# -- quality rules --------------------------------------------------------------


def base(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count, cover = Counter(win), set()
    for k, x in enumerate(win):
        if count[x] > 1:
            cover.update(range(k, k + 5))
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)


def test_base_columns_equal_brute_force(spark):
    rng = random.Random(1)
    texts = awkward() + [" ".join(rng.choice("ab") for _ in range(n)) for n in (4, 5, 6, 9, 10, 11, 30)] + ["l\nl\n \n\nm\nl", "a\x0bb\x0cc\x85d e", "#" * 20 + " $%&|<>*"]
    got = sorted(tuple(r)[:7] for r in op10_rules.judged(docs(spark, texts), spark.createDataFrame([], "doc_id long, quality int")).collect())
    assert got == [(k, *base(t)) for k, t in enumerate(texts)]


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    rows = [(0, 100), (3, 100), (40, 3000), (0, 1)]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("p", op10_rules.binomial_tail(F.col("k"), F.col("n"), 0.02))
    for r in df.collect():
        assert r["p"] == pytest.approx(sum(math.comb(r["n"], i) * 0.02**i * 0.98 ** (r["n"] - i) for i in range(r["k"] + 1)), rel=1e-9)


def test_thresholds_reject_junk_and_few_good_documents(spark):
    rng = random.Random(5)
    n = 4000
    texts = [" ".join(f"w{rng.randrange(5000)}" + ("###" if k % 5 == 0 else "") for _ in range(20)) for k in range(n)]
    df = docs(spark, texts)
    labels = spark.createDataFrame([(k, int(k % 5 > 0)) for k in range(n)] + [(1, None), (1, 1)], "doc_id long, quality int")
    got = op10_rules.judged(df, labels).toPandas()
    good = got["doc_id"] % 5 > 0
    assert got[good]["kept"].mean() >= 1 - len(op10_rules.CUTOFFS) * op10_rules.RISK and not got[~good]["kept"].any()
    few = op10_rules.judged(df, labels.where("doc_id < 100")).toPandas()  # too few to certify anything
    assert (few["kept"] == ~few["base_failed"]).all()
    assert op10_rules.judged(df.limit(0), labels).count() == 0


def test_cutoffs_are_in_force_and_equal_exact_tails(spark, data):
    d = data.replace("0.001", "0.01")
    docs_, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    kept = saved(op10_rules.statistics(docs_))
    stats = kept.toPandas()
    good = set(labels.where("quality = 1").toPandas()["doc_id"])
    got = {r["s"]: r.asDict() for r in op10_rules.cutoffs(kept, labels.where("quality = 1")).collect()}
    level, in_force = op10_rules.DELTA / (len(op10_rules.CUTOFFS) * len(op10_rules.BANDS)), 0
    for s, rows in stats[~stats["base_failed"] & stats["doc_id"].isin(good)].groupby("stratum"):
        for rule, cuts in op10_rules.CUTOFFS.items():
            want, n = None, len(rows)
            for c in cuts:
                k = int((rows[rule] > c).sum())
                if sum(math.comb(n, i) * op10_rules.RISK**i * (1 - op10_rules.RISK) ** (n - i) for i in range(k + 1)) > level:
                    break
                want = c
            assert got[s][f"{rule}_cut"] == want
            in_force += want is not None
    out = queries.op10_quality_rules(spark, d).toPandas()
    assert in_force and (out["kept"] < ~out["base_failed"]).any()


def test_native_plans_hold_no_python(spark, data):
    for q in (queries.op6_decontaminate_report, queries.op10_quality_rules):
        plan = q(spark, data)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan.replace("ArrowCollect", ""))


# -- pipeline -------------------------------------------------------------------


def test_pipeline_equals_its_stages_by_brute_force(spark, data):
    from .test_dedup import components, kept_words

    df = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in stages.quality(spark, df, data).collect()}
    ids = sorted(rows)
    kept = [i for i, (*_, k) in zip(ids, components([rows[i] for i in ids], 5, 80), strict=True) if k]
    texts = {}
    for i, w, gone in kept_words([(i, rows[i]) for i in kept]):
        spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", rows[i])]
        ends = [s for s, _ in spans[1:]] + [len(rows[i])]
        texts[i] = (rows[i][: spans[0][0]] if spans else rows[i]) + "".join(rows[i][a:b] for (a, _), b, g in zip(spans, ends, gone, strict=True) if not g)
        assert len(w) == len(spans)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    clean = [i for i, (*_, hit) in zip(texts, contaminated(texts.values(), bench), strict=True) if not hit]
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, len(x := lib.encode(texts[i], add_bos=True, add_eos=True)), hashlib.sha256(np.array(x, dtype="<u4").tobytes()).hexdigest()) for i in clean]
    got = sorted(tuple(r)[:3] for r in corpus_pipeline.run(spark, data).collect())
    assert got == want
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "tokens"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, data, name):
    data = data.replace("0.001", "0.01") if name == "op10_quality_rules" else data  # where cutoffs are in force
    c = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, data).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = (d[sorted(d.columns)].sort_values("doc_id").reset_index(drop=True) for d in (got, want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
