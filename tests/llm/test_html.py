"""Main texts of pages: made sites whose article texts are known, names that don't decide, broken pages, time."""

import random
import time

import pytest

pytest.importorskip("docflow.llm")
from docflow.llm import html  # noqa: E402

SCHEMA = "page_id long, url string, html string, text string, n_chars int"


def text_of(page: str, template=frozenset()) -> str:
    root = html.parse(page)
    html.digest(root)
    return html.extract(root, template)


ARTICLE = "<article><h1>Title</h1><p>First part of it.</p><p>Second part.</p></article>"
BODY = "Title\nFirst part of it.\nSecond part."


@pytest.mark.parametrize("page", [
    f"<div class='layout has-sidebar'>{ARTICLE}</div>", f"<div class='sidebar'>{ARTICLE}</div>", f"<body class='comments share'>{ARTICLE}<div class='ad'>Buy</div></body>", f"<div id='comments'><main>{ARTICLE}</main></div>",
    f"<div class='no-comments with-ads'>{ARTICLE}</div><div class='comment-list item'>I say no.</div>", f"<div class='AD-12 box'>Buy</div>{ARTICLE}<div class='cookie-notice'>We store</div>",
    f"{ARTICLE}<article class='comment'>I say no.</article>", ARTICLE.replace("<article>", "<article class='notice'>"), f"<aside>x</aside><div class='site-footer'>y</div>{ARTICLE}",
    "<main class='content share-page'><h1>Title</h1><p>First part of it.</p><p>Second part.</p></main>",
])
def test_names(page):
    assert text_of(page) == BODY


def test_sections_stay():
    page = ARTICLE.replace("</article>", "<section id='discussion'><h2>Discussion</h2><p>We found it.</p></section><section id='comments'><p>First!</p></section></article>")
    assert text_of(page) == BODY + "\nDiscussion\nWe found it."


@pytest.mark.parametrize(("page", "want"), [
    ("<article><p>a<p>b<ul><li>c<li>d</ul>e</article>", "a\nb\nc\nd\ne"), ("<article><table><tr><td>a<td>b<tr><th>c</table></article>", "a\nb\nc"), ("<article><dl><dt>a<dd>b<dt>c</dl></article>", "a\nb\nc"),
    ("<article>a<b>b<i>c</b>d</i> &lt;e&gt; &amp;amp;</article>", "abcd <e> &amp;"), ("<article><p title=\"x > y\">a</p></article>", "a"), ("<article><p title=\"x>a</p><p>b</p></article>", "a\nb"), ("<article>a<!-- <p>no --> b<br>c</article>", "a b c"),
    ("<article><script>if (a < b) '</p>'</script>a<style>p{}</style></article>", "a"), ("<article>a</section></i></p>b", "ab"), ("", ""), ("<", "<"), ("a < b", "a < b"), ("<div><i>a<div>b</i>c</div></div>", "a\nbc"),
])
def test_broken_pages(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("page", [
    "<b>" * 170_000 + "</i>" * 120_000, "<i><div>" + "<b>" * 150_000 + "</i>" * 100_000, "<b>" * 150_000 + "<hr>" * 100_000, "<div>" * 100_000 + "<li>" * 100_000, "<div>" * 200_000, '<b ">' * 200_000, "<table>" * 50_000 + "<td>" * 100_000, "<a b='" * 150_000, "<article>x</article>" * 50_000,
], ids=lambda p: p[:12])
def test_time(page):
    began = time.time()
    text_of(page)
    assert time.time() - began < 8  # a MB; the quadratic walk took minutes


def site(rng, host, n):
    """Pages of a host with what recurs on them and what doesn't, and the article's text."""
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    said = lambda k=12: " ".join(word() for _ in range(rng.randrange(1, k)))
    bar, note = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in [word() for _ in range(4)]), f"<div class='x{word()}'><p>{said()} & more</p></div>"
    for _ in range(n):
        title, parts = said(), [said(30) for _ in range(rng.randrange(1, 5))]
        marked = [p.replace(" ", " <b>", 1) + "</b>" if " " in p else p for p in parts]
        page = (
            f"<html><head><title>{said()}</title><script>x('</p>')</script></head><body><div><ul>{bar}</ul></div><div class='ad'>{said()}</div><article><h1>{title}</h1>"
            + "".join(f"<p>{m}</p>\n" for m in marked) + note + f"<aside>{said()}</aside></article><div class='comments'><p>{said()}</p></div><footer>{said()}</footer></body></html>"
        )
        yield f"https://{host}/{word()}", page, "\n".join([title, *parts])


def test_templates(spark):
    rng = random.Random(9)
    rows = [r for h, n in (("one.org", 40), ("two.org:80", 12), ("three.org", 5)) for r in site(rng, h, n)]
    rows.append(("https://alone.org/x", *next(iter(site(rng, "alone.org", 1)))[1:]))
    frame = spark.createDataFrame([(k, u, p, "clash", 5) for k, (u, p, _) in enumerate(rows)] * 2 + [(None, None, None, None, None), (None, "no host", "", "x", 1)], SCHEMA)
    got = html.main_text(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = got.collect()
    assert len(found) == 2 * len(rows) + 2
    for r in found:
        if r["page_id"] is None:
            assert (r["text"], r["n_chars"]) == ("", 0)
        elif r["page_id"] < len(rows) - 1:
            assert r["text"] == rows[r["page_id"]][2] and r["n_chars"] == len(r["text"])
        else:  # a page of its own has no template, so the block that recurs elsewhere stays
            assert r["text"].startswith(rows[-1][2])
    assert html.main_text(frame.limit(0)).count() == 0


def test_template_is_what_recurs(spark):
    """The hashes of a host are those on a fifth of its different pages, three at least, counted one by one."""
    rng = random.Random(3)
    blocks = [f"<div><p>block {k} of text</p></div>" for k in range(8)]
    pages = [(k, "http://h.org/", "<body>" + "".join(b for j, b in enumerate(blocks) if rng.random() < (j + 1) / 10) + f"<article><p>own {k % 25}</p></article></body>") for k in range(30)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("_host", html.host_of("url")).withColumn("_html", html.F.col("html").cast("binary"))
    got = {h for r in html.templates(frame).collect() for h in r["template"]}
    seen: dict[int, set] = {}
    mains = set()
    for _, _, p in pages:
        root = html.parse(p)
        html.digest(root)
        main = tuple(r.hash for r in html.main_roots(root))
        mains.add(main)
        for h in html.candidates(root):
            seen.setdefault(h, set()).add(main)
    assert got == {h for h, on in seen.items() if len(on) >= max(3, 0.2 * len(mains))}
