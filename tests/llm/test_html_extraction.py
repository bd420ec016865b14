import random
import time
from html import escape

from marlstone.llm.html_extraction import extract, main_text

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="nav-open">
<header class="site"><a href="/">Home</a> banner</header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies.</div>
<article><header><h1>The &amp; title</h1></header><p>First   <b>bo</b>ld paragraph,
with enough words to be content of its own.<br>Next line</p><p>Two.</p><div class="ad">Buy it</div>
<aside>Aside</aside><form><label>Name</label></form><script>var t="</p>";</script>
<p>Unclosed paragraph &copy; 2020<p>Last</article>
<section id="comments"><article><p>A reader writes a rather long comment about the article here.</p></article></section>
<footer>Foot</footer></body></html>"""


def test_article_only():
    assert main_text(PAGE) == "The & title First bold paragraph, with enough words to be content of its own. Next line Two. Unclosed paragraph © 2020 Last"


def test_without_article_element():
    page = (
        "<body><div class='menu'>Menu</div><div id='content'><h1>Head of it</h1><p>A long paragraph of words that make content.</p>"
        "<p>Short.</p><p>Another long paragraph of words that make content.</p></div><div class='sidebar'>Side</div></body>"
    )
    assert main_text(page) == "Head of it A long paragraph of words that make content. Short. Another long paragraph of words that make content."


def test_unclosed_advert_and_truncation():
    assert main_text("<div class='ad'>Buy<article><p>Text of the article &am") == "Text of the article &am"
    assert main_text("") == "" and main_text("<p></p>") == ""


def test_rows(llm_spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "<p>" + "word " * 50_000, "x")]
    got = extract(llm_spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.n_chars) for r in got][2:] == [(2, 0), (None, 249_999)] and got[0] == got[1]
    assert extract(llm_spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


STORY = "A long paragraph of many plain words that make the content of this page here. "


def test_cards_do_not_replace_the_story():
    cards = "".join(f"<article><p>Card {k} tells in one sentence of another story.</p></article>" for k in range(3))
    main = f"<div id='story'><h1>Head</h1>{('<p>' + STORY * 4 + '</p>') * 6}</div>"
    want = " ".join(["Head", *[STORY * 4] * 6]).split()
    for page in (f"<body>{main}<div class='related'>{cards}</div></body>", f"<body><div>{main}</div><div class='teasers'><div>{cards}</div></div></body>", f"<body>{main}{cards.replace('<article>', '<article class=teaser>')}</body>"):
        assert main_text(page).split() == want
    assert main_text(f"<body>{main}<section>{cards}</section></body>").split()[: len(want)] == want
    assert main_text("<div class='ad'>Buy" + f"<article class='post tag-search'><p>{STORY}</p></article><div class='related'>{cards}</div>").split() == STORY.split()


def test_sibling_articles_stay():
    page = "<body><div>" + "".join(f"<article><p>{k} {STORY * k}</p></article>" for k in (5, 2, 2)) + "</div></body>"
    assert main_text(page).split() == " ".join(f"{k} {STORY * k}" for k in (5, 2, 2)).split()


def test_open_head_and_marked_words():
    assert main_text("<html><head><title>t</title><body><p>Some words of the page.</p>") == "Some words of the page."
    page = f"<article><p>See the <span class='search'>search page</span> and <a class='share-link' href='/x'>this link</a> at the end.</p><p>{STORY}</p></article>"
    assert main_text(page).startswith("See the search page and this link at the end. A long")


def test_sections_named_like_boxes():
    page = f"<article><p>{STORY * 3}</p><section class='related-work'><h2>Related work</h2><p>Others {STORY * 3}</p></section><div class='related-links'><a href='/a'>{STORY}</a></div></article>"
    assert main_text(page).split() == f"{STORY * 3} Related work Others {STORY * 3}".split()


def test_depth_costs_no_more_than_length():
    # Of divs that are never closed, the deepest that holds 0.9 of the text is the region.
    for page, size in (("<div>x " * 50_000, 89_999), ("<b>" * 50_000 + "<hr>y" * 50_000, 99_999)):
        began = time.perf_counter()
        assert len(main_text(page)) == size and time.perf_counter() - began < 20
    began = time.perf_counter()
    main_text("<div class='ad'>" * 20_000 + "<article>y" * 20_000 + "</div>" * 20_000)
    assert time.perf_counter() - began < 20


def test_planted_articles_come_back():
    """Pages built around a known text, with everything that is not the article, give exactly that text."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abdeghilmnoprstuvé&<") for _ in range(rnd.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    boxes = [
        lambda: f"<nav><ul>{''.join(f'<li><a href=/x>{escape(word())}</a>' for _ in range(6))}</ul></nav>", lambda: f"<div class='ad-slot'>{escape(prose(12))}</div>",
        lambda: f"<aside><p>{escape(prose(20))}</p></aside>", lambda: f"<div id=cookie-banner>{escape(prose(15))}</div>", lambda: f"<form><label>{escape(prose(3))}</label><input></form>",
        lambda: f"<section class='comments'><p>{escape(prose(40))}</p></section>", lambda: f"<script>{word().replace('<', '')}</script><!-- {word().replace('<', '')} -->", lambda: f"<footer>{escape(prose(25))}</footer>",
    ]
    for _ in range(60):
        blocks = [prose(rnd.randint(3, 8))] + [prose(rnd.choice([4, 40, 90])) for _ in range(rnd.randint(3, 9))] + [prose(60)]
        body = [f"<h1>{escape(blocks[0])}</h1>", *(f"<p>{escape(b)}{rnd.choice(['</p>', ''])}" for b in blocks[1:])]
        for _ in range(rnd.randint(0, 2)):
            body.insert(rnd.randint(1, len(body) - 1), rnd.choice(boxes[1:4])())
        around = [rnd.choice(boxes)() for _ in range(rnd.randint(0, 4))]
        behind = [rnd.choice(boxes)() for _ in range(rnd.randint(0, 3))]
        page = f"<html><head><title>{escape(word())}</title>{rnd.choice(['</head>', ''])}<body>{''.join(around)}<article>{''.join(body)}</article>{''.join(behind)}"
        assert main_text(page) == " ".join(" ".join(b.split()) for b in blocks), page


def test_formulas_share_boxes_and_headlines_beside():
    formula = "<math><mi>E</mi><mo>=</mo><mi>m</mi><annotation>E=m</annotation></math>"
    assert main_text(f"<article><p>{STORY} It says {formula} for short.</p></article>").split() == f"{STORY} It says E=m for short.".split()
    page = f"<article><h1>Head</h1><p>{STORY}</p><div class='share-buttons'>Share</div><section class='related-work'><h2>Related work</h2><p>{STORY}</p></section></article>"
    assert main_text(page).split() == f"Head {STORY} Related work {STORY}".split()
    for around in ("<main><h1>Head</h1>{}</main>", "<body><nav>Menu</nav><h1>Head</h1>{}<footer>f</footer></body>"):
        assert main_text(around.format(f"<article><p>{STORY}</p><p>{STORY}</p></article>")).split() == f"Head {STORY} {STORY}".split()
    own = f"<body><h1>Site</h1><article><h1>Head</h1><p>{STORY}</p></article></body>"
    assert main_text(own).split() == f"Head {STORY}".split()
