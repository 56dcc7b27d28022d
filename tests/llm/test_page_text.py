import math
import random
import time

import numpy as np
from pyspark.sql import functions as F
from stavemill.llm import page_text as P

LONG = "The quick brown fox jumps over the lazy dog again and again until the evening comes. " * 3


def test_leaves_out_what_is_not_the_article():
    html = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script>
    </head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav>
    <div class="cookie-notice">We use cookies. {LONG}</div><aside>{LONG}</aside><div id="sidebar">{LONG}</div>
    <article><h1>Head &amp; line</h1><p>{LONG}<p>Short.<p>One<br>two&nbsp;three<ul><li>a</li><li>b</li></ul>
    <div class="ad banner">Buy</div><form><p>Mail<input></form><script>x</script><p hidden>no</p></article>
    <section class="comments"><article class="comment"><p>{LONG}</p></article></section>
    <footer>&copy; {LONG}</footer></body></html>"""
    flat = " ".join(LONG.split())
    assert P.main_text(html) == f"Head & line\n{flat}\nShort.\nOne two three\na\nb"


def test_region_without_article_elements():
    body = "".join(f"<p>{LONG}</p><p>tiny</p>" for _ in range(3))
    links = "".join(f"<li><a href=/{i}>go {i}</a></li>" for i in range(20))
    got = P.main_text(f"<body><div><ul>{links}</ul></div><div class=content><h2>H</h2>{body}</div>"
                      f"<div><ul>{links}</ul></div></body>").split("\n")
    assert got[0] == "H" and got.count("tiny") == 3 and len(got) == 7


def test_all_content_regions_are_kept():
    flat = " ".join(LONG.split())
    big = f"<p>{LONG}</p>" * 6
    many = f"<p>{LONG}</p>" * 11
    nav = "<div><ul>" + "".join(f"<li><a href=/{i}>go</a></li>" for i in range(20)) + "</ul></div>"
    part = f"<h2>Second</h2><p>{LONG}</p><p>tiny</p><p>{LONG}</p>"
    want = ["Second", flat, "tiny", flat]
    for html, n in ((f"<main><article>{big}</article><section>{part}</section></main>", 6),
                    (f"<body>{nav}<article>{big}</article><article>{part}</article>{nav}</body>", 6),
                    (f"<body>{nav}<div>{many}</div><div><p>{LONG}</p></div>{nav}</body>", 11)):
        got = P.main_text(html).split("\n")
        assert got[:n] == [flat] * n
        if n == 6:
            # a heading before the content lines belongs to their container
            assert got[n:] == want
        else:
            assert got[n:] == [flat]


def test_articles_made_of_random_blocks_come_back():
    rng = random.Random(3)
    for _ in range(50):
        blocks = [" ".join(rng.choice(["a", "bb", "ccc", "é&lt;", "x<b>y</b>"])
                           for _ in range(rng.choice([1, 2, 30, 80]))) for _ in range(rng.randint(1, 9))]
        page = ("<nav><a>m</a></nav><div class='ad'>w w w</div><article>"
                + "".join(f"<p>{b}\n</p>" if rng.random() < 0.7 else f"<p>{b}<br>" for b in blocks)
                + "</article><footer>f f f f</footer>")
        want = "\n".join(b.replace("&lt;", "<").replace("<b>", "").replace("</b>", "") for b in blocks)
        assert P.main_text(page) == want


def test_defined_cases(spark):
    assert P.main_text(None) == P.main_text("") == P.main_text("<p> </p>") == ""
    assert P.main_text("<nav>unclosed <article><p>text</article>") == "text"
    assert P.main_text("plain &am") == "plain &am"
    assert P.main_text("</p></div><p>a</span>b") == "ab"
    rows = [(1, None, None), (None, "u", "<p>a</p>"), (2, "u", "<p>b</p>"), (2, "u", "<p>b</p>"),
            (3, "u", "<article>" + "<p>w</p>" * 20_000 + "</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("q", F.lit(1))
    got = P.extracted(df)
    assert got.columns == ["page_id", "url", "q", "text"]
    assert sorted((str(r.page_id), len(r.text)) for r in got.collect()) == [
        ("1", 0), ("2", 1), ("2", 1), ("3", 39_999), ("None", 1)]
    assert P.extracted(df.limit(0)).count() == 0


def test_innocent_class_names_keep_their_text():
    text = "A sentence of the article that is long enough to be content. " * 3
    for name in ("content-with-ads", "article-header-text", "has-sidebar", "post-with-comments-open", "no-footer",
                 "download social-science"):
        assert P.main_text(f'<article><div class="{name}"><p>{text}</p></div></article>') == text.strip(), name
    for name in ("ad", "ad-box", "sidebar-left", "site_footer", "top-nav", "cookie-notice", "wide advert"):
        assert P.main_text(f'<body><div class="{name}"><p>No.</p></div><p>{text}</p></body>') == text.strip(), name


def test_broken_declarations_do_not_stop_a_page():
    rng = random.Random(5)
    pieces = ["<![", "<!", "<![ x ]>", "<![CDATA[", "]]>", "<![if !IE]>", "<![endif]-->", "<!DOCTYPE", "<?", ">", "<", "</",
              "</p", "<p>", "<article>", "</article>", "<div", " class='ad'", "&#x;", "&amp", "-->", "<!--", "text ", "\x00",
              "<![%", "<![IGNORE[", "<!ELEMENT [", "\"", "'"]
    for _ in range(3000):
        P.main_text("".join(rng.choice(pieces) for _ in range(rng.randint(1, 25))))
    assert P.main_text("<article><p>One two.</p><![ x ]><p>Three.</p></article>") == "One two.\nThree."


def test_deep_nesting_takes_linear_time():
    for html in ("<div>a" * 50_000, "<div>" * 50_000 + "</x>" * 50_000 + "a", "<span>" * 20_000 + "<p>a" * 20_000,
                 "<div><p>a</p>" * 30_000 + "</div>" * 30_000):
        start = time.perf_counter()
        assert "a" in P.main_text(html)
        assert time.perf_counter() - start < 20


def test_ratios_smoothing_and_threshold_against_brute_force():
    rng = random.Random(8)
    for _ in range(200):
        lines = [(rng.choice([1, 5, 90, 300]) * rng.randint(1, 5), rng.randint(0, 6)) for _ in range(rng.randint(1, 30))]
        ratio = [n / max(1, tags) for n, tags in lines]
        smooth = []
        for i in range(len(ratio)):
            near = [(math.exp(-(j - i) ** 2 / 2), ratio[j]) for j in range(max(0, i - 2), min(len(ratio), i + 3))]
            smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
        mean = sum(smooth) / len(smooth)
        edge = math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth))
        want = [x >= edge for x in smooth]
        if not any(want):
            want = [n == max(n for n, _ in lines) for n, _ in lines]
        size, tags = (np.array(x, float) for x in zip(*lines))
        assert np.allclose(P.smoothed(size / np.maximum(1, tags)), smooth)
        assert list(P.content_lines(size, tags)) == want
