import pytest

from packetflow.llm import main_text as m

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body class="home">
<nav><ul><li><a href="/a">Menu one</a></li><li><a href="/b">two</a></li></ul></nav><!-- ad --><div class="ad">Buy this now</div>
<article>{}</article><aside>Side words here</aside><footer>&copy; somebody</footer></body></html>"""
BODY = "<h1>Head &amp; line</h1><p><b>First&nbsp;words of it</b> and\n more,<br>next<p>Second para&#8212;graph with a <a href='x>y'>link</a>ed word.</p>"
TEXT = "Head & line First words of it and more, next Second para—graph with a linked word."


@pytest.fixture(scope="module")
def weights():
    rows = [x for i in range(30) for x in m.counts(PAGE.format(f"<p>Some words number {i} of the text, a good deal of them.</p>" * 5))]
    return m.Weights(rows)


def test_marked_article(weights):
    assert m.extract(PAGE.format(BODY), weights) == TEXT


def test_parts_of_an_article_that_are_no_text(weights):
    extra = "<form>Your mail <input> <button>Send</button></form><div class='cookie-notice'>We use cookies</div><section id='comments'><p>Nice!</p><p>Agreed, very nice indeed.</p></section>"
    assert m.extract(PAGE.format(BODY + extra + "<p>Last.</p>"), weights) == TEXT + " Last."


def test_page_without_a_marked_article(weights):
    long = "".join(f"<p>Paragraph {i} goes on for a good many words so that it counts as text.</p>" for i in range(6))
    page = f"<body><div class='menu'><a>Home</a><a>News</a></div><div id='content'>{long}</div><div class='sidebar'><p>Other stories to read</p></div><footer>Imprint</footer>"
    assert m.extract(page, weights) == " ".join(f"Paragraph {i} goes on for a good many words so that it counts as text." for i in range(6))


def test_best_run_beats_link_lists(weights):
    links = "<ul>" + "<li><a href='/x'>go</a></li>" * 30 + "</ul>"
    text = "Here stands a long paragraph of words that nobody has marked at all in this page."
    assert m.extract(f"<body>{links}<p>{text}</p>{links}", weights) == text


def test_broken_markup(weights):
    assert m.extract("", weights) == "" and m.extract("no markup &lt; at\tall", weights) == "no markup < at all"
    assert m.extract("<article><p>Cut off <b>here", weights) == "Cut off here"
    assert m.extract("<article><p>One</p><!-- never closed <p>two</p>", weights) == "One"
    assert m.extract("<article><p>One</p><script>never closed", weights) == "One"
    assert m.extract("<article></section></p>Text</div></article><footer>no</footer>", weights) == "Text"
    assert m.extract("<article><p>a < b and c</p><di", weights) == "a < b and c"
    deep = "<div>" * 3000 + "<article><p>deep</p></article>"
    assert m.extract(deep, weights) == "deep"


def test_query_shape_nulls_and_empty(spark):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, "u", PAGE.format(BODY), "t"), (2, "u", PAGE.format(BODY), "t"), (3, None, "", "t")], "page_id long, url string, html string, text string")
    learned = m.learn(pages)
    got = pages.select("page_id", m.main_text(spark, learned, pages.html).alias("x")).collect()
    assert sorted((r.page_id, r.x) for r in got) == [(1, ""), (2, TEXT), (2, TEXT), (3, "")]
    assert m.extract(PAGE.format(BODY), m.learn(pages.limit(0))) == TEXT


def test_marks_that_are_removed_or_stand_elsewhere(weights):
    body, text = BODY + "<p>A last paragraph of some ten words stands at the end.</p>", TEXT + " A last paragraph of some ten words stands at the end."
    assert m.extract(PAGE.replace("<article>", "<div>").replace("</article>", "</div>").format(body), weights) == text
    comments = "".join(f"<article class='comment'><p>Reader {i} says a great many words here, more of them than stand in the text.</p></article>" for i in range(9))
    assert m.extract(f"<body><nav><a>Home</a></nav><div>{body}</div>{comments}<footer>Imprint</footer>", weights) == text
    teaser = "<aside><article><p>Another story that you may like to read.</p></article></aside>"
    assert m.extract(f"<body><div>{body}</div>{teaser}", weights) == text
    assert m.extract(f"<body><p>A summary stands before the article and belongs to it.</p><article>{body}</article>", weights) == "A summary stands before the article and belongs to it. " + text
