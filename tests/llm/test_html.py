import html
import random
import re
import time

import duckdb
import pytest

from tessera.llm.html import extract, main_text

PROSE = "The river ran past the old mill, and nobody had crossed it since the flood; that was long ago. "


def test_generated_pages_keep_the_article_only():
    rows = duckdb.sql("select html from '/root/testdata/sf0.001/pages.parquet'").fetchall()
    assert rows
    for (page,) in rows:
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)\b[^>]*>", body)
        want = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b)))).strip() for b in blocks]
        assert main_text(page) == "\n".join(b for b in want if b)


def test_page_without_article_by_tag_paths():
    page = (
        "<html><body><div class=top><a href=/>Home</a> <a href=/x>News</a></div><div class='site-header'>Site</div>"
        + "<div id=story>" + "".join(f"<p>{PROSE * 2}<i>{k}</i></p>" for k in range(6)) + "</div>"
        + "<div class=links>" + "".join(f"<a href=/{k}>Link number {k}</a><br>" for k in range(20)) + "</div>"
        + "<div class='cookie-notice'>" + PROSE * 3 + "</div><section id=comments><p>" + PROSE + "</p></section><footer>(c) 2020</footer></body></html>"
    )
    text = main_text(page)
    assert text.split("\n") == [(PROSE * 2 + str(k)).strip() for k in range(6)]


def test_marked_elements_weigh_in_the_ratios():
    story = [PROSE * 2 + str(k) for k in range(6)]
    body = "".join(f"<p>{x}</p>" for x in story)
    teaser = "<article class=teaser><p>More of it</p></article>"
    # an article inside of main takes nothing from main's own text, and a teaser nothing from a long story that no element marks
    assert set(story) <= set(main_text(f"<body><main><div>{body}</div>{teaser}</main></body>").split("\n"))
    assert set(story) <= set(main_text(f"<body><div id=story>{body}</div>{teaser}</body>").split("\n"))
    # links score nothing in main; an article's linked heading and its short cells stay, text beside the article does not
    links = "<div class=more>" + "".join(f"<p><a href=/{k}>Link number {k}</a></p>" for k in range(20)) + "</div>"
    assert main_text(f"<main>{body}{links}</main>").split("\n") == story
    table = "<ul><li>x</li></ul><dl><dt>w</dt></dl><table><tr><td>1</td></tr></table>"
    assert main_text(f"<div>{PROSE}</div><article><h1><a href=/>Title</a></h1>{body}{table}</article>").split("\n") == ["Title", *story, "x", "w", "1"]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<nav>a</nav>", ""),
        ("<article>a &amp; b&nbsp;c &#8364;<!-- x --><script>y</script></article>", "a & b c €"),
        ("<article><p>a<p>b<ul><li>c<li>d</ul><table><tr><td>e<td>f</table></article>", "a\nb\nc\nd\ne\nf"),
        ("<article><header><h1>Title</h1></header><p>Text<br>more</p><aside>no</aside><div class='comments'>no</div><form>no</form></article><p>no</p>", "Title\nText more"),
        ("<ARTICLE><P CLASS=\"x > y\">a</P><p style='display:none'>no</p><p", "a"),
        ("<article>unclosed <b>bold <i>both</article> after", "unclosed bold both"),
        ("<main><p>a</p><div role=navigation>no</div></main><p>no</p>", "a"),
        ("<article><p>one &lt;tag&gt; two</p></article>", "one <tag> two"),
        ("<article><pre>a\n  b</pre></article>", "a b"),
    ],
)
def test_cases(page, want):
    assert main_text(page) == want


def plain_ratios(page):
    """The method once more, over the paths that the standard library's parser gives, without any shared code: for
    well-formed pages without off, named or marked elements."""
    import math
    from html.parser import HTMLParser

    texts = []

    class Reader(HTMLParser):
        path, links = (), 0

        def handle_starttag(self, tag, attrs):
            self.path += ((tag, *sorted(attrs)) if tag != "a" else ("a",),)

        def handle_endtag(self, tag):
            self.path = self.path[:-1]

        def handle_data(self, data):
            if data.strip():
                linked = ("a",) in self.path
                texts.append((tuple(x for x in self.path if x != ("a",)), data.strip(), linked))

    Reader().feed(page)
    paths = list(dict.fromkeys(t[0] for t in texts))
    own = {p: [t for t in texts if t[0] == p] for p in paths}
    size = {p: sum(len(t[1]) for t in own[p]) for p in paths}

    def smooth(values):
        out = []
        for i in range(len(values)):
            near = [(math.exp(-((i - j) ** 2) / 2), values[j]) for j in range(max(0, i - 2), min(len(values), i + 3))]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    length = smooth([size[p] / len(own[p]) for p in paths])
    marks = smooth([sum(len(re.findall("[.,;:!?]", t[1])) for t in own[p]) / len(own[p]) for p in paths])
    score = {p: a * (1 + b) * (1 - sum(len(t[1]) for t in own[p] if t[2]) / size[p]) for p, a, b in zip(paths, length, marks)}
    mean = sum(score[p] * size[p] for p in paths) / max(1, sum(size.values()))
    return "\n".join(t[1] for t in texts if score[t[0]] >= 0.25 * mean and score[t[0]] > 0)


@pytest.mark.parametrize("seed", range(40))
def test_pages_without_marks_match_plain_ratios(seed):
    rng = random.Random(seed)
    words = "the river ran, past it. old mill; nobody had crossed since flood".split()

    def block(depth):
        kind = rng.choice(["div", "section", "p", "ul", "blockquote"]) if depth else "div"
        cls = rng.choice(["", "", " class=x", " id=story", " class=y2"])
        if kind == "ul":
            return f"<ul{cls}>" + "".join(f"<li><a href=/>{' '.join(rng.choices(words, k=rng.randint(1, 3)))}</a></li>" for _ in range(rng.randint(1, 6))) + "</ul>"
        if kind == "p" or depth > 4:
            return f"<p{cls}>{' '.join(rng.choices(words, k=rng.choice([1, 2, 5, 30, 60])))}</p>"
        return f"<{kind}{cls}>" + "".join(block(depth + 1) for _ in range(rng.randint(1, 5))) + f"</{kind}>"

    page = f"<body>{''.join(block(0) for _ in range(rng.randint(1, 4)))}</body>"
    assert main_text(page) == plain_ratios(page)


def test_names_weigh_and_do_not_decide():
    story = "".join(f"<p>{PROSE * 3}{k}</p>" for k in range(5))
    for name in ("share-price", "related", "side", "alert", "login"):
        assert f"{PROSE * 3}4" in main_text(f"<body><div class='{name}'>{story}</div><p>Short.</p></body>")
        beside = f"<body><article>{story}</article><div class='{name}'><p>{PROSE}</p></div></body>"
        assert main_text(beside) == main_text(f"<article>{story}</article>")
    assert main_text("<article><p>So <math><mi>x</mi> = 1</math> holds, <object>it</object> <svg><text>is</text></svg> said.</p></article>") == "So x = 1 holds, it is said."


def test_any_depth():
    for depth in (200, 300, 5000):
        page = "<div>" * depth + f"<p>{PROSE}</p>" + "</div>" * depth + "<ul><li><a href=/>Home</a></ul>"
        assert main_text(page) == PROSE.strip()
    page = "<article>" + "<b>" * 500 + "<p>one<p>two<ul><li><p>three<li>four</ul>"
    assert main_text(page) == "one\ntwo\nthree\nfour"


def test_hostile_pages_are_linear():
    rng = random.Random(0)
    for page in ("<" * 300_000, "<div>" * 60_000, "<p>" * 100_000, "<b>" * 50_000 + "<p>" * 50_000, "<div>" * 40_000 + "</span></div>" * 40_000, "<i><u>" * 30_000 + "</u>" * 60_000, "<a b='" * 50_000, "<!--" * 80_000, "&" * 300_000, "</p>" * 80_000, "<script>" + "x" * 300_000, "".join(rng.choice("<>/abp= '\"&;!-") for _ in range(200_000))):
        began = time.time()
        main_text(page)
        assert time.time() - began < 10, page[:20]


def test_rows(spark):
    rows = [(1, "u", "<article>a</article>"), (1, "u", "<article>a</article>"), (None, None, None), (3, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "5 AS text", "6 AS n_chars")
    assert sorted(map(tuple, extract(pages).collect()), key=str) == sorted([(1, "u", "a", 1)] * 2 + [(None, None, "", 0), (3, "v", "", 0)], key=str)
    assert extract(pages.limit(0)).count() == 0
