import html
import re

import numpy as np

from labelsieve.llm import suffix_html as sh
from labelsieve.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="menu">
    <nav><ul><li>no</li></ul></nav><!-- <p>no</p> --><div class="ad box">no<div>no</div></div><article><header>no</header>
    <h1>A &amp; B&#x41; &lt;p&gt;</h1><p>one<br>two <b>th</b>ree<p>four&nbsp;\n five<div id="comments"><p>no</div><form>no</form>
    <p class="ad-top">no<p>six <a href="x>y">seven</a></p><aside>no</article><p>out</p><footer>no</footer></body></html>"""
    texts, kinds = sh.blocks_of(page)
    assert [t for t, k in zip(texts, kinds) if k == sh.ARTICLE] == ["A & BA <p>", "one two three", "four five", "six seven"]
    assert [t for t, k in zip(texts, kinds) if k == sh.OTHER] == ["out"]
    assert sh.blocks_of("") == ([], []) and sh.blocks_of("<") == (["<"], [1])


def test_repeated_words_equal_brute_force():
    generator = np.random.default_rng(5)
    for run in (1, 2, 3, 5, 8):
        tokens = generator.integers(0, 3, 400)
        pages = np.sort(generator.integers(0, 9, 400))
        runs = {}
        for i in range(len(tokens) - run + 1):
            if pages[i] == pages[i + run - 1]:
                runs.setdefault(tuple(tokens[i:i + run]), []).append(i)
        want = np.zeros(len(tokens), dtype=bool)
        for places in runs.values():
            if len({pages[i] for i in places}) > 1:
                for i in places:
                    want[i:i + run] = True
        assert (sh.repeated_words(tokens, pages, run) == want).all()


def test_pages_without_article_lose_repeated_runs(spark):
    line = "one two three four five six seven eight nine"
    rows = [(n, f"http://a.example/{n}", f"<p>{line} {n}</p><p>own words of page {n}</p>") for n in range(3)]
    rows += [(9, "http://b.example/", f"<p>{line}</p>"), (10, None, None), (11, "x", ""), (9, "http://b.example/", f"<p>{line}</p>")]
    got = sorted((r.page_id, r.text) for r in sh.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html").collect())
    assert got == [(n, f"{n}\nown words of page {n}") for n in range(3)] + [(9, line)] * 2 + [(10, ""), (11, "")]
    assert sh.main_text(spark.createDataFrame([], "page_id long, url string, html string"), "url", "html").collect() == []


def test_query_equals_the_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op5_suffix_html"](spark, SF).collect()
    assert len(rows) == len(pages)
    for row in rows:
        article = re.search(r"<article>(.*)</article>", pages[row.page_id].html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", part.replace("<br>", " ")))).strip() for part in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n".join(b for b in blocks if b)
        assert row.n_chars == len(row.text) and row.url == pages[row.page_id].url


def test_copies_under_other_urls_keep_their_text(spark):
    line, own = "one two three four five six seven eight nine", "own words of a page that several addresses of the host hold"
    rows = [(n, f"http://a.example/{n}", f"<p>{line}</p><p>{own}</p>") for n in range(3)]
    rows += [(3, "http://a.example/3", f"<div>{line}</div><div>{own}</div>"), (4, "http://a.example/4", f"<p>{line}</p><p>another page</p>")]
    got = {r.page_id: r.text for r in sh.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html").collect()}
    assert got == {n: own for n in range(4)} | {4: "another page"}


def test_result_does_not_depend_on_the_size_of_a_part(spark):
    generator = np.random.default_rng(7)
    rows = []
    for n in range(60):
        words = [f"w{generator.integers(0, 300)}" for _ in range(30)]
        quoted = " ".join(rows[n - 1][2].split("<p>")[1].split()[:12]) if n % 3 == 1 else ""
        rows.append((n, f"http://{'ab'[n % 2 // (1 + n % 3)]}.example/{n}", f"<p>{' '.join(words)} {quoted}<p>all pages of the host end with these very nine words"))
    rows += [(n + 100, f"http://a.example/copy/{n}", rows[n][2].replace("<p>", "<div>")) for n in range(0, 60, 7)] + [rows[0]] * 3
    rows += [(200, None, None), (201, "x", ""), (202, "http://b.example/", "<p>short"), (203, "http://b.example/", "<article>" + rows[2][2] + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole, *dealt = (sorted(tuple(r) for r in sh.main_text(pages, "url", "html", part_bytes=size).collect()) for size in (1 << 20, 700, 1))
    assert sum(r[3] for r in whole) > 0
    assert dealt == [whole, whole]
