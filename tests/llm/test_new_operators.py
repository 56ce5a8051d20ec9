"""HTML extraction, K2-treap search and collocation mining: plain versions over made tables, odd rows, and pages of other builds than the tables'."""

import math
import re
import time
from collections import Counter, defaultdict
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docmill.llm import treap
from docmill.llm.collocations import _frequent_hashes, collocations, encoded, ranked, scores_at
from docmill.llm.common import to_ranges
from docmill.llm.pages import extract_main_text, main_text, page_lines
from docmill.llm.treap import Held, K2Treap, ranked_search, terms_of

LONG = "This paragraph says what the page is about, in a sentence or two that nobody would put in a menu."


@pytest.mark.parametrize(
    "page, text",
    [
        (f"<body><nav>Home</nav><article><h1>T</h1><p>a &amp; b<p>c<br>d<aside>See also</aside></article><footer>f", "T a & b c d"),
        (f'<div id="header"><h1>Site</h1></div><div class="main-menu"><a href=1>A</a></div><div id="content"><h1>Title</h1><p>{LONG}</p><p>Short.</p><div class="ad-slot">Buy!</div><p>End.</p></div><div class="sidebar-left"><p>{LONG}</p></div>', f"Title {LONG} Short. End."),
        (f'<form id="aspnet"><main><p>Text in a <b>bo</b>ld form.</p><form>Name <input> <button>Go</button></form></main></form>', "Text in a bold form."),
        (f'<article><p>One.</p></article><section id="comments"><article class="comment"><p>{LONG}</p></article></section>', "One."),
        (f'<ul><li><a href="/a">Home page of the site</a></li><li><a href="/b">All of the other pages that there are</a></li></ul><div><div><h2>Head</h2><p>{LONG}</p></div></div><div><div>Copyright 2020</div></div>', f"Head {LONG}"),
        ("<p>x &lt;b&gt; 1 < 2 &nbsp; y&#233;</p><script>var t='</p><p>no'</script><style>p{}</style><!-- <p>no</p> --><textarea>no</textarea>", "x <b> 1 < 2 yé"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>1<td>2</table></article>", "one two 1 2"),
        ('<div class="cookie-notice">We use cookies</div><div itemprop="articleBody">Body</div>', "Body"),
        ('<body class="has-sidebar"><article class="post with-comments">Kept</article>', "Kept"),
        ("<article><header><h1>Head</h1></header>Text<footer>Tags</footer></article>", "Head Text"),
        ("", ""),
        (None, ""),
        ("<nav>only a menu</nav><foot", "only a menu"),
        ("no markup   at\n all", "no markup at all"),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


def test_pages_of_odd_markup_take_linear_time():
    began = time.time()
    for page in ("<a " * 200_000, '<p x="' * 100_000, "<div>" * 50_000 + "x" + "</span>" * 50_000, "<nav>" * 30_000 + "x", "<!--" * 100_000, "<article>" * 30_000 + "x" + "</article>" * 30_000, "<style></styl " * 50_000, "< " * 200_000, "<p>" * 100_000):
        main_text(page)
    assert time.time() - began < 60
    assert main_text("<article>" + "<p>word</p>" * 50_000 + "</article>") == " ".join(["word"] * 50_000)
    assert all(len(line) == 3 for line in page_lines("<p>a<p>b"))


def test_pages_of_odd_tables(spark):
    pages = spark.createDataFrame([(1, "u", "<article>a", 1), (1, "u", "<article>a", 1), (None, None, None, None), (3, "", "", 5)], "page_id long, url string, html string, `n_chars` int")
    pages = pages.select("*", F.lit("x").alias("text"), F.lit(1).alias("a.b"))
    assert sorted(map(tuple, extract_main_text(pages).collect()), key=repr) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (3, "", "", 0)], key=repr)
    assert extract_main_text(pages.limit(0)).collect() == []


def plain_search(docs, items, k=20):
    words = [(i, Counter(w), len(w)) for i, w in ((i, terms_of((t or "").encode())) for i, t in docs)]
    n_docs, n_terms = sum(n > 0 for *_, n in words), sum(n for *_, n in words)
    df = Counter(t for _, c, _ in words for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, counts, n in words:
            m = 75 + (25 * n * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 12 * m)) for t in terms_of((text or "").encode()) if counts[t])
            if s > 0:
                scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [3, 64, 8192])
def test_search_against_all_documents(spark, monkeypatch, shard):
    monkeypatch.setattr(treap, "SHARD", shard)
    monkeypatch.setattr(treap, "STEP", 4)
    rng = np.random.default_rng(shard)
    text = lambda n: " ".join(f"w{x}" for x in rng.zipf(1.3, n) % 400)
    docs = [(i, text(rng.integers(0, 60))) for i in range(300)] + [(7, "w1 w2"), (7, "w1 w2"), (None, "W1, w2"), (None, None), (400, "")] + [(500 + i, "same w5 w6") for i in range(60)] + [(900, text(30_000))]
    items = [(i, text(12)) for i in range(15)] + [(3, "w5 w5 same"), (None, "w1"), (20, ""), (21, None), (22, "nothing-here")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").select("*", F.lit(1).alias("n"), F.lit(2).alias("score"), F.lit(3).alias("a.b")).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(1).alias("rank"))
    assert sorted(map(tuple, ranked_search(frame, asked).collect()), key=repr) == plain_search(docs, items)
    assert ranked_search(frame.limit(0), asked).collect() == [] and ranked_search(frame, asked.limit(0)).collect() == []


def test_items_in_blocks(spark, monkeypatch):
    docs = [(i, f"a{i} b{i % 3} c") for i in range(30)]
    items = [(i, f"a{i} b1 c") for i in range(9)]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for name, most in (("BLOCK_TERMS", 4), ("BLOCK_ITEMS", 2)):
        monkeypatch.setattr(treap, name, most)
        assert sorted(map(tuple, ranked_search(*frames).collect()), key=repr) == plain_search(docs, items)


def test_treap_opens_few_ranges():
    """One document far above all others is found without scoring the rest."""
    n = 4096
    rows, columns = np.repeat(np.arange(4), n), np.tile(np.arange(n), 4)
    factors = np.full(4 * n, 1000)
    factors[np.arange(4) * n + 77] = 900_000
    tree = K2Treap(rows, columns, factors, np.full(4, 5000), n)
    scored = []

    class Watch(Held):
        def put(self, score, *rest):
            scored.append(len(score))
            super().put(score, *rest)

    held = Watch(1)
    treap_step, treap.STEP = treap.STEP, 1
    try:
        tree.best(np.arange(4), np.ones(4, np.int64), held, np.arange(n), np.zeros(n, bool))
    finally:
        treap.STEP = treap_step
    assert held.id.tolist() == [77] and held.score.tolist() == [4 * 5000 * 900_000]
    assert sum(scored) < 100


def plain_collocations(docs, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(rb"[.,;:!?\x0a-\x0d]", (text or "").encode().lower()):
            w = [x for x in re.split(rb"[ \t]", piece) if x]
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i : i + m]] = max(around[p[i : i + m]], a)
        rows = []
        for p, a in cand.items():
            if 100 * around[p] >= 80 * a:
                continue
            s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, b" ".join(p), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for i, r in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize("top, frontier", [(2000, None), (15, 3), (40, 40)])
def test_collocations_against_all_phrases(spark, top, frontier):
    rng = np.random.default_rng(5)
    words = ["of", "the", "x", "y", "z", "São", "new", "york", "city", "times", "in", "spite"] + [f"v{i}" for i in range(40)]
    text = lambda n: " ".join(words[min(int(x) - 1, len(words) - 1)] for x in rng.zipf(1.4, n))
    docs = [(["en", "de", None][i % 3], text(120) + "\n" + text(30) + "," + text(9)) for i in range(90)]
    docs += [("en", f"in spite\tof the new york city times! V{i} x\x0by") for i in range(40)] + [("de", "a b c d e " * 12)] * 4 + [("und", "x of y"), ("fr", None), ("fr", ""), (None, "...")] + [("en", "new york city times")] * 40
    frame = spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, lang string, text string").select("*", F.lit(1).alias("c"), F.lit(2).alias("a.b")).repartition(4)
    got = sorted(map(tuple, collocations(frame, 10, top, frontier).collect()))
    assert got == plain_collocations(docs, 10, top)


def test_collocations_of_nothing(spark):
    assert collocations(spark.createDataFrame([], "doc_id long, lang string, text string")).collect() == []
    assert collocations(spark.createDataFrame([(1, None, None), (2, "en", "one two")], "doc_id long, lang string, text string")).collect() == []


def test_codes_are_decoded_a_few_rows_at_once(spark):
    """Spark's reader decodes a row group of up to 4,096 rows at once; rows of codes hold a megabyte of text."""
    frame = spark.createDataFrame([(f"l{i % 40}", f"one two {i}") for i in range(400)], "lang string, text string").coalesce(1)
    codes = encoded(frame)
    groups = [meta.row_group(i).num_rows for f in codes.inputFiles() for meta in [pq.ParquetFile(urlparse(f).path).metadata] for i in range(meta.num_row_groups)]
    assert sum(groups) == codes.count() == 40
    assert max(groups) <= 8


def test_hashes_of_a_range_lie_in_one_block_of_the_bitmap():
    """Else each task has a row for every block, and the last sum gets as many times the bitmap as there are tasks."""
    h = np.random.default_rng(1).integers(0, 2**64, 200_000, np.uint64)
    schema = pa.schema([("kind", pa.int32()), ("range", pa.int64()), ("h", pa.list_(pa.int64())), ("c", pa.list_(pa.int64()))])
    dealt = to_ranges(schema, 0, h, 12, h.view(np.int64), np.ones(len(h), np.int64))
    at = [b.column(0).to_numpy() for b in _frequent_hashes(1)([dealt])]
    assert sum(map(len, at)) == len(h)
    assert all(len(np.unique(x // 32768)) == 1 for x in at)


def test_ranks_and_scores_with_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(lang, f"p{i}", int(a), int(s)) for lang, n in (("en", 700), ("de", 90), ("fr", 3)) for i, (a, s) in enumerate(rng.integers(0, 6, (n, 2)))]
    frame = spark.createDataFrame(rows, "lang string, phrase string, a long, score long")
    best = {lang: sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[3], -r[2], r[1])) for lang in ("en", "de", "fr")}
    assert dict(scores_at(frame, 50).collect()) == {lang: best[lang][49][3] for lang in ("en", "de")}
    got = sorted((r.lang, r.rank, r.phrase) for r in ranked(frame, 60).collect())
    assert got == sorted((lang, i + 1, r[1]) for lang, of in best.items() for i, r in enumerate(of[:60]))
