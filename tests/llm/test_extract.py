import random
import time

import pytest

from agentframe.llm import extract
from agentframe.llm.markup import Page

STORY = [f"Paragraph {i} tells at some length what happened on that day, and why; it has words enough to count as text." for i in range(4)]
HEAD = '<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>'
NAV = '<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>'
COOKIES = '<div class="cookie-notice">We use cookies to make this site better for you, as everybody does these days, sorry about that.</div>'
COMMENTS = '<section id="comments"><h2>Comments</h2><div class="comment"><p>' + "A reader says a lot about this and that, much more than the article does. " * 20 + "</p></div></section>"
PAGES = {
    "article": f'{HEAD}<body><header><h1>Site</h1></header>{NAV}<article><h1>Title &amp; more</h1>' + "".join(f"<p>{p}</p>" for p in STORY) + f'</article><aside>Aside</aside>{COMMENTS}<footer>Foot</footer></body></html>',
    "div": f'{HEAD}<body><div class="site-header"><p>Site</p></div>{NAV}{COOKIES}<div id="wrap"><div class="post-content"><h1>Title &amp; more</h1>' + "".join(f"<p>{p}" for p in STORY) + f'<div class="ad">Buy this now</div></div><div class="sidebar"><p>Side text that is quite long too</p></div></div>{COMMENTS}<div id="footer">Foot</div>',
    "sections": f'{HEAD}<body>{NAV}<main><article><header><h1>Title &#38; more</h1><p>By somebody</p></header>' + f"<p>{STORY[0]}</p>" + "".join(f"<section><p>{p}</p></section>" for p in STORY[1:]) + f'<ul class="x"><li><a href="/r">Related one</a></li><li><a href="/s">Related two</a></li></ul></article></main>{COMMENTS}',
    "form": f'{HEAD}<body><form action="/"><input name=q>{NAV}<div class="entry"><h1>Title &amp; more</h1>' + "".join(f"<div>{p}</div>" for p in STORY) + "</div></form><p>short</p></body></html>",
    "table": f'{HEAD}<body><table><tr><td class="menu"><a href=/>Home</a><td class="text"><h1>Title &amp; more</h1>' + "".join(f"<p><b>{p}</b>" for p in STORY) + "</table>",
}
WANT = "\n".join(["Title & more", *STORY])


@pytest.mark.parametrize("name", sorted(PAGES))
def test_main_text(name):
    assert extract.main_text(PAGES[name], []) == WANT


def test_consensus_overrules_a_page():
    """Most pages of the host have their text in div.story; on one the box beside it is longer, and has no telling name."""
    text = "A sentence that is long enough to be text. "
    page = lambda story, box: f'<body><div class="a-1"><div class="c1">{story}</div></div><div class="b"><div class="c2"><p>{box}</p></div></div></body>'
    usual, odd = page(f"<p>{text * 9}</p>", text), page(f"<p>{text * 5}</p>", text * 7)
    votes = [v for s in [usual] * 9 + [odd] for v in extract.votes_of(s)]
    count = {}
    for path, shown, share, _ in votes:
        count[path, shown] = count.get((path, shown), 0) + share
    winner = max(count, key=count.get)
    assert winner[1] == "body/div.a-#/div.c#" and extract.main_text(odd, []) == (text * 7).strip()
    assert extract.main_text(odd, [(winner[0], 9.0)]) == (text * 5).strip()


def test_consensus_in_spark(spark):
    text = "A sentence that is long enough to be text. "
    page = lambda a, b: f'<div class="left"><p>{text * a}</p></div><div class="right"><p>{text * b}</p></div>'
    rows = [(i, f"http://One.example/{i}", page(9, 1), "x", 1) for i in range(8)] + [(100, "https://u@one.example:8080/odd", page(5, 7), "x", 1), (101, "http://two.example/", page(5, 7), "x", 1)]
    rows += [(102, None, page(5, 7), "x", 1), (103, "http://one.example/none", None, "x", 1), (104, "http://one.example/empty", "", "x", 1), (105, "no url", "plain words", "x", 1), (0, rows[0][1], rows[0][2], "x", 1)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, TEXT string, `meta.url` int")
    out = extract.extract(frame)
    assert out.columns == ["page_id", "url", "html", "meta.url", "text", "n_chars"]
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == len(rows) and all(r.n_chars == len(r.text) for r in out.collect())
    assert got[100] == (text * 5).strip() and got[101] == got[102] == (text * 7).strip() and got[103] == got[104] == "" and got[105] == "plain words" and got[3] == (text * 9).strip()
    joined = extract.extract(frame.where("page_id >= 0"))
    assert extract.extract(frame.where("false")).collect() == [] and joined.count() == len(rows)


def test_winners_may_be_joined(spark, monkeypatch):
    monkeypatch.setattr(extract, "BROADCAST_HOSTS", 0)
    test_consensus_in_spark(spark)


def test_odd_markup():
    assert extract.main_text("a<b", []) == "a" and extract.main_text("1 < 2 &lt; 3 <!-- x", []) == "1 < 2 < 3"
    assert extract.main_text('<p>x <a title="a > b">y</a>  z<br>w</p><p hidden>no</p><span class="ad">no <span>no</span></span><p>t', []) == "x y z w\nt"
    assert extract.main_text("<div><p>one</div></div></p>two</article>", []) == "one\ntwo"
    assert extract.main_text("<article><p>text</p><script>no", []) == "text"
    assert extract.main_text('<article class="comment-9"><p>no no no</p></article><article class="post has-comments"><p>yes</p></article>', []) == "yes"


@pytest.mark.parametrize("piece", ["<div>", "<b>", "<p><b>", "</div>", "<", "<a '", '<a x="', "&#", "<!-", "<li><div>", "<div class='a1'><p>word", "<a href=x>y", "x=y ", "<p class=" + "a" * 50 + " ", "<h1>", "<aside>", "<form>", "<span class=ad>"])
def test_time_is_linear(piece):
    def seconds(n):
        began = time.process_time()
        extract.main_text(piece * n, [])
        extract.votes_of(piece * n)
        return time.process_time() - began

    seconds(2000)
    one, four = min(seconds(10_000) for _ in range(2)), seconds(40_000)
    assert four < 9 * one + 0.2


def test_random_pages_lose_nothing_of_the_article():
    rng = random.Random(5)
    for _ in range(200):
        story = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))]
        body = "".join(rng.choice((f"<p>{p}</p>", f"<p>{p}", f"<p><b>{p}</b></p>", f"<div>{p}</div>", f"<p>  {p}\n</p>", f"<ul><li>{p}</ul>")) for p in story)
        junk = rng.choice((NAV, COOKIES, COMMENTS, "<aside>x y z</aside>", '<div class="ad"><p>Buy</p></div>', "<!-- <p>c</p> -->", "<script>'<p>'</script>"))
        assert extract.main_text(f"<body>{junk}<article>{body}</article>{junk}", []) == "\n".join(story)
        assert len(Page(f"<body>{junk}<article>{body}</article>").blocks) >= len(story)
