"""Operators on pages and vectors, and the registered queries."""

from collections import Counter

import numpy as np

from loomspan.llm.embedding_dedup import embedding_dedup
from loomspan.llm.html_text import extract_text, html_text
from loomspan.llm.url_filter import RULES, Globs, Rule, filter_urls

from .test_text_ops import components, got


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for r in RULES:
        h, p = r.text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(r.text) > len(best.text)):
            best = r
    return host, path, best and best.text, best.verdict if best else "allow"


def test_url_filter(spark):
    urls = ["http://a.org/x", "http://ORG/", "http://org", "http://forg/", "https://www.EXAMPLE.org/es/1?x=/", "https://example.org/en/1", "https://example.org/en/12#/z", "https://notexample.org/es/", "ftp://x.com/fr/", "http://x.com/de/?q", "http://y.net/x.org/", "http://x.com?/de/", None, "", "no scheme", "://", "http://Ü.org/é", "a://b://c.org/", "http://x.com/" + "de/" * 5000, "http://h.org/\n/x"]
    df = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls + urls)], "page_id long, url string, host int, h int")
    want = Counter((i, *brute_url(u)) for i, u in enumerate(urls + urls))
    assert got(filter_urls(df, RULES), "page_id", "host", "path", "rule", "verdict") == want
    assert filter_urls(df.limit(0), RULES).count() == 0
    many = [Rule(f"h{k}.org/p{k}/", "block") for k in range(300)]
    hit = [r["rule"] for r in filter_urls(spark.createDataFrame([("http://a.h299.org/p299/x",)], "url string"), many).collect()]
    assert hit == ["h299.org/p299/"]


def test_globs():
    from fnmatch import fnmatchcase

    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("ab/"), rng.integers(0, 9))) for _ in range(400)]
    patterns = ["a**b", "**", "a", "", "*a/**", "**ab**a", "*", "a*b/**b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    hit = Globs(patterns).match(data, off)
    for t, row in zip(texts, hit, strict=True):
        for p, h in zip(patterns, row, strict=True):
            if "*" not in p.replace("**", ""):
                assert h == fnmatchcase(t, p.replace("**", "*")), (t, p)
    assert [bool(x) for x in Globs(["*"]).match(data, off)[:, 0]] == ["/" not in t for t in texts]


PAGE = """<html><head><title>No</title><style>x</style></head><body class="with-sidebar"><header><h1>Site</h1></header><nav><ul><li>Home</ul></nav>
<article><header><h1>The  title</h1><p>By someone</p></header><p>Long <b>first</b> paragraph &amp; text&nbsp;here, with many words<br>in it, and then more.
<p>Short.<div class="advert">Buy</div><p>Another long paragraph with enough words to be an article of its own.<script>var t="</p>";</script></p><form>Mail</form></article>
<aside>Side</aside><section id="comments"><p>I like this article very much, thank you for writing it all down here.</p></section><footer>&copy; us</footer>"""


def test_html_text(spark):
    want = "The title\nLong first paragraph & text here, with many words in it, and then more.\nShort.\nAnother long paragraph with enough words to be an article of its own."
    assert extract_text(PAGE) == want
    assert extract_text(None) == extract_text("") == extract_text("<nav>x</nav>") == ""
    assert extract_text("<p>only</p>") == "only"
    plain = "<div class='site-header'>Site</div><div id=wrap><div class='entry-header'><h2>Title</h2></div><p>A long paragraph of the article with many words in it.</p><p>End.</p><div class='cookie-bar'>Cookies</div></div>"
    assert extract_text(plain) == "Title\nA long paragraph of the article with many words in it.\nEnd."
    assert extract_text("<![bad <p>text</p>") is not None
    long = "<article>" + "<p>some words in a paragraph</p>" * 20_000 + "</article>"
    assert extract_text(long).count("\n") == 19_999
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (2, None, None, 5), (3, "u", "", 5)], "page_id long, url string, html string, text int")
    assert got(html_text(df), "page_id", "text", "n_chars") == Counter({(1, want, len(want)): 1, (2, "", 0): 2, (3, "", 0): 1})
    assert html_text(df.limit(0)).count() == 0


def test_embedding_dedup(spark):
    rng = np.random.default_rng(5)
    rows, base = [], rng.standard_normal((40, 16))
    for i, b in enumerate(base):
        for _ in range(30 if i == 0 else int(rng.integers(1, 5))):
            rows.append([len(rows), (b + rng.standard_normal(16) * 0.05 * rng.integers(0, 3)).astype(np.float32).tolist(), i % 3])
    rows += [[len(rows), rows[0][1], 0], [len(rows) + 1, [x * 2 for x in rows[0][1]], 0], [len(rows) + 2, rows[0][1], None], [len(rows) + 3, None, 0], [len(rows) + 4, [0.0] * 16, 0], [len(rows) + 5, [float("nan")] * 16, 0], [len(rows) + 6, [None] * 16, 0], [len(rows) + 7, [], 0], [len(rows) + 8, [1.0, 2.0], 0]]
    ok = [r[1] is not None and r[2] is not None and len(r[1]) > 0 and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1]) for r in rows]

    def linked(a, b):
        if not (ok[a] and ok[b]) or rows[a][2] != rows[b][2] or len(rows[a][1]) != len(rows[b][1]):
            return False
        x, y = np.array(rows[a][1]), np.array(rows[b][1])
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    comp = components(len(rows), linked)
    degree = [sum(linked(a, b) for b in range(len(rows)) if b != a) for a in range(len(rows))]
    want = Counter((r[0], degree[i], comp[i], comp[i] == i) for i, r in enumerate(rows))
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, h int, dim int").repartition(3)
    for most in (2048, 4):  # with small cells in one piece, or dealt out as pairs of blocks
        assert got(embedding_dedup(df, bits=6, tables=24, max_cell=most), "vec_id", "n_links", "component_id", "kept") == want
    assert embedding_dedup(df.limit(0)).count() == 0
