import itertools

import pytest

from siftline.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site name and the slogan of the house</header>
<nav><ul><li><a href="/a">the first</a></li><li>of the menu</li></ul></nav><!-- an advert --><div class="ad">Buy the best of the best in town and be happy with it for the rest of your life.</div>
<article><h1>A &amp; B&nbsp;story</h1><p><b>This is the first   paragraph of the story, and it has many words in it for the test.<br><p>Short.</p>
<p>Then comes another one with &lt;signs&gt; &#8212; and it goes on for a while so that it is long enough to count.</p><div class="comments"><p>I am a reader and this is what I think of the story.</p></div></article>
<aside>See the other stories of the day</aside><form><input value="x">Search the site</form><div id="cookie-notice">We use cookies on this site</div><footer>&copy; all of the rights</footer></body></html>"""


def test_main_text():
    want = "A & B story\nThis is the first paragraph of the story, and it has many words in it for the test.\nShort.\nThen comes another one with <signs> — and it goes on for a while so that it is long enough to count."
    assert html_text.main_text(PAGE) == want


def test_page_without_article():
    good = "It was the best of times and it was the worst of times, and the people of the town were in the streets of the old city for the whole of the day."
    page = f"<body><div><a href='x'>Home</a> <a href='y'>News</a></div><p>{good}</p><p>And so on.</p><p>{good}</p><div><a href='z'>More</a></div></body>"
    assert html_text.main_text(page) == f"{good}\nAnd so on.\n{good}"
    assert html_text.main_text(None) == html_text.main_text("") == "" and html_text.main_text("just words") == "just words"
    assert html_text.main_text("<p>one<p>two <b>three") == "one\ntwo three"


def test_pages(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "<p>" + "word " * 100_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert len(got) == 4 and got[0]["text"] == got[1]["text"] and got[2]["text"] == "" and len(got[3]["text"]) == 499_999
    assert html_text.extract(df.where("false")).count() == 0
    pages = html_text.op6_html_extraction(spark, "/root/testdata/sf0.001").toPandas()
    assert len(pages) == 50 and (pages.n_chars == pages.text.str.len()).all() and not pages.text.str.contains("©").any()


GOOD = "It was the best of times and it was the worst of times, and the people of the town were in the streets of the old city for the whole of the day."
NOTICE = "We use cookies on this site so that it is of use to you, and with these and those of our partners we see how it is used and what is of interest to you."


@pytest.mark.parametrize(
    "page",
    [
        f'<p data-note="was hidden">{GOOD}</p><p hidden>{GOOD}</p><p style="color:red; display: none">{GOOD}</p><p aria-hidden=true>{GOOD}</p>',
        f'<div class="overflow-hidden" style="overflow:hidden" data-hidden="no"><p>{GOOD}</p></div>',
        f'<article class="story search-results-story"><p>{GOOD}</p></article>',
        f'<article><div class="social widget-body"><p>{GOOD}</p></div></article>',
        f'<p data-a=it\'s>{GOOD}</p>',
        f'<p class="x>{GOOD}</p>',
        f'<div class="layout right-sidebar"><article><p>{GOOD}</p></article><div class="sidebar"><p>{GOOD}{GOOD}</p></div></div>',
        f'<body class="comments-enabled"><p>{GOOD}</p><div id="comments"><p>{GOOD}{GOOD}</p></div></body>',
        f'<p>{GOOD}</p><div class="cookie-notice"><p>{NOTICE}</p></div><div role="alert">{NOTICE}</div>',
        f'<article><p>{GOOD}</p><div class="share-buttons">Share it with all of your friends</div><section class="reader-comments"><p>{GOOD}</p><p>{GOOD}</p></section></article>',
        f'<nav>Home</nav><svg/><iframe src=x></iframe><p title="a > b">{GOOD}</p><script>if (a < b) x("</p>")</script>',
        f'<div>Home News Contact</div><p>{GOOD}</p><ul><li><a href=x>More of the news</a></li></ul>',
    ],
)
def test_paragraphs_stay_and_no_markup(page):
    assert html_text.main_text(page) == GOOD


def test_language_without_stop_words():
    one, two = "Это было лучшее из всех времён, это было худшее из всех времён, это был век мудрости.", "Это был век глупости, это были годы веры, это были годы безверия, пора света и пора тьмы."
    page = f"<div>Главная Новости Контакты</div><p>{one}</p><p>Коротко.</p><p>{two}</p><div>Все права защищены</div>"
    assert html_text.main_text(page) == f"{one}\nКоротко.\n{two}"


def test_article_keeps_linked_paragraphs():
    assert html_text.main_text(f"<article><p><a href=x>Alice Smith</a>, <a href=y>Bob</a></p><p>{GOOD}</p><p>Yes</p></article>") == f"Alice Smith, Bob\n{GOOD}\nYes"


def test_header_of_an_article_belongs_to_it():
    page = f'<div class="site-header">The Daily Town and all of its news</div><article><header><p>On a day of the week</p></header><div class="post-header"><h1>Title</h1></div><p>{GOOD}</p></article>'
    assert html_text.main_text(page) == f"On a day of the week\nTitle\n{GOOD}"


def test_unbalanced_quotes_take_no_text():
    page = f'<p class="x>{GOOD}</p><p class="y">{GOOD}</p><a href="z>and more</a><p id=\'q>{GOOD}</p>'
    got = html_text.main_text(page)
    assert got.count(GOOD) == 3 and "<" not in got and "class" not in got


def plain_pass(labels):
    """The second pass, looked up block by block and step by step."""
    out = []
    for k in range(len(labels)):
        for far in range(len(labels) + 1):
            near = [labels[i] for i in (k - far, k + far) if 0 <= i < len(labels) and labels[i] != "undecided"]
            if near:
                out.append("text" in near)
                break
        else:
            out.append(True)
    return out


def test_second_pass_against_plain():
    for n in range(8):
        for labels in itertools.product(("text", "boilerplate", "undecided"), repeat=n):
            assert html_text.inherited(list(labels)) == plain_pass(labels)


def plain_class(text, linked, heading):
    words = text.split()
    stop = sum(w.strip(".,;:!?()[]«»\"'").lower() in html_text.STOP_WORDS for w in words) / len(words)
    if linked > len(text) / 2:
        return "boilerplate"
    if len(text) < 70:
        return "undecided" if heading or stop > 0 or text[-1] in ".!?" else "fragment"
    return "text" if stop >= 0.3 or (stop >= 0.2 and len(text) >= 200) else "undecided"


def test_first_pass_against_plain():
    words = ["of", "the", "stream", "river", "and", "mountains", "Haus"]
    for n, step, linked, heading, end in itertools.product(range(1, 60, 4), range(1, 7), (0, 20, 400), (False, True), ("", ".")):
        text = " ".join(words[i * step % 7] for i in range(n)) + end
        assert html_text.classify(html_text.Block(text, linked, False, heading, "")) == plain_class(text, linked, heading)
