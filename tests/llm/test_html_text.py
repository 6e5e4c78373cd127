import random

import numpy as np
import pytest

from seqloom.llm import html_text
from seqloom.llm.queries import op2_main_text


def marked(page):
    blocks = html_text.page_blocks(page)
    best = next((z for z in ("article", "main") if any(b[0] == z for b in blocks)), "other")
    return " ".join(t for z, t in blocks if z == best)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<body><nav><a>x</a></nav><article><h1>T &amp; U</h1><p>a<b>b</b>\n\n c<br>d<p>e</article><footer>f</footer>", "T & U ab c d e"),
        ("<article><p>one</p><div class='comments'><p>no</p></div><aside>no</aside><form>no</form><p>two", "one two"),
        ("<main><header>menu</header><p>x</p></main>", "x"),
        ("<article><header><h1>x</h1></header>y<footer>z</footer></article>", "x y"),
        ("<script>var t='</p><article>'</script><article>a<style>p{}</style>b<!-- <p>c --></article>", "ab"),
        ("<article>1 < 2 &lt;b&gt; &am &copy &#233;&#xe9;</article>", "1 < 2 <b> &am © éé"),
        ("<article>cut<p class='x", "cut"),
        ("<article>cut<!-- no end", "cut"),
        ("<DIV ID=cookie-notice>no</DIV><ARTICLE>Yes<SCRIPT>no</ARTICLE>", "Yes"),
        ("<p title='a > b'>x</p><p hidden>y</p><div role=navigation>z</div>", "x"),
        ("<article><p>a</p><ul><li>b<li>c</ul><table><tr><td>d<td>e</table></article>", "a b c d e"),
        ("", ""),
        ("plain", "plain"),
        ("</p></div>x</nav>y", "x y"),
    ],
)
def test_page_blocks(page, text):
    assert marked(page) == text


@pytest.mark.parametrize("depth", [1, 2, 3, 5, 8, 13])
def test_suffix_ranks_sort_by_the_first_tokens(depth):
    r = random.Random(depth)
    tokens = np.array([r.randrange(3) for _ in range(200)], np.uint64)
    rank = html_text.suffix_ranks(tokens, depth)
    heads = [tuple(tokens[i : i + depth].tolist()) for i in range(200)]
    order = {h: n for n, h in enumerate(sorted(set(heads)))}
    assert rank.tolist() == [order[h] for h in heads]


def brute(pages, run=html_text.MIN_RUN):
    """(unique text, covered words) of each (host, words) page: windows that another page of the host has too."""
    where = {}
    for n, (host, words) in enumerate(pages):
        for i in range(len(words) - run + 1):
            where.setdefault((host, tuple(words[i : i + run])), set()).add(n)
    out = []
    for host, words in pages:
        covered = {j for i in range(len(words) - run + 1) if len(where[host, tuple(words[i : i + run])]) > 1 for j in range(i, i + run)}
        out.append((" ".join(w for j, w in enumerate(words) if j not in covered), len(covered)))
    return out


@pytest.mark.parametrize("shard_tokens", [10**6, 300])
def test_unmarked_pages_equal_brute_force(spark, shard_tokens):
    r = random.Random(8)
    banner = [f"b{i}" for i in range(14)]
    pages = []
    for n in range(120):
        words = [f"w{r.randrange(3000)}" for _ in range(r.randrange(40))]
        at = r.randrange(len(words) + 1)
        if r.random() < 0.5:
            words[at:at] = banner[: r.randrange(5, 15)]
        pages.append((r.choice(["a.org", "a.org", "b.org", ""]), words))
    rows = [(n, f"http://{h}/{n}" if h else None, f"<body><p>{' '.join(w[:7])}</p><div>{' '.join(w[7:])}</div><nav>menu</nav>") for n, (h, w) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {x.page_id: (x.text, x.repeated_words) for x in html_text.main_text(df, shard_tokens=shard_tokens).collect()}
    assert [got[n] for n in range(len(pages))] == brute(pages)


def test_whole_table(spark, sf):
    import html as h
    import re

    source = {x.page_id: x.html or "" for x in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op2_main_text(spark, sf).collect()
    assert len(rows) == len(source)
    for x in rows:
        m = re.search(r"<article>(.*?)(</article>|$)", source[x.page_id], re.S)
        text = re.sub(r"<[^>]*(>|$)", "", re.sub(r"<(?:/?(?:p|h1)|br)>", " ", m[1])) if m else ""
        assert x.text == " ".join(h.unescape(text).split()) and x.n_chars == len(x.text)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "http://a/", "", "x"), (None, "http://a/", "<p>z</p>" * 20_000, "x"), (2, "no host", "<article>é</article>", "x")], "page_id long, url string, html string, text string")
    got = sorted(((x.page_id, x.text[:3], x.n_chars) for x in html_text.main_text(df).collect()), key=str)
    assert got == sorted([(1, "", 0), (1, "", 0), (None, "z z", 39_999), (2, "é", 1)], key=str)
    assert html_text.main_text(df.limit(0)).count() == 0
