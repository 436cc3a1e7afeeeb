import random
import time

from tracefold.llm import html_text

ARTICLE = "<div><h2>Title</h2><p>" + "long text of the story " * 20 + "</p><p>" + "more text of the story " * 20 + "</p><p>" + "last text of the story " * 20 + "</p></div>"
LINKS = "<ul>" + "".join(f'<li><a href="/{i}">Other page {i}</a></li>' for i in range(12)) + "</ul>"
TEASERS = "<div>" + "".join(f'<div><a href="/t{i}"><b>Teaser {i}</b></a><span>by us</span></div>' for i in range(6)) + "</div>"


def test_unnamed_boilerplate_in_a_wrapper_goes():
    for page in (f"<body><div id=page>{LINKS}{ARTICLE}{TEASERS}</div></body>", f"<body><div id=page><div>{LINKS}</div><div>{ARTICLE}</div></div></body>"):
        text = html_text.main_text(page)
        assert text.startswith("Title\nlong text") and text.endswith("last text of the story") and text.count("\n") == 3
        assert "Other page" not in text and "Teaser" not in text


def test_text_in_two_blocks_of_the_body_stays():
    second = "<div><p>" + "a second <b>piece <i>of</i></b> the story " * 15 + "</p><p>" + "the end of the story " * 20 + "</p></div>"
    text = html_text.main_text(f"<body>{LINKS}{ARTICLE}{second}</body>")
    assert text.startswith("Title\nlong text") and "a second piece of the story" in text and text.endswith("the end of the story") and "Other page" not in text


def generated(rng):
    """A page with unnamed boilerplate around paragraphs, and the texts of its blocks in order."""

    def prose(n):
        return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n))

    def marked(text):
        words = text.split(" ")
        at = rng.randrange(len(words))
        words[at] = rng.choice(("<b>{}</b>", "<a href='/x?a=1&amp;b=2'>{}</a>", "<i class=x>{}</i>", "{}")).format(words[at])
        return rng.choice((" ", "\n  ", "\t")).join(words)

    def links():
        return "<ul>" + "".join(f'<li><a href="/{i}">{prose(2)}</a></li>' for i in range(rng.randint(6, 30))) + "</ul>"

    want, blocks = [], []
    for _ in range(rng.randint(3, 8)):
        want.append(prose(rng.randint(40, 90)))
        blocks.append(f"<p>{marked(want[-1])}" + rng.choice(("</p>", "")))
    for _ in range(rng.randint(0, 3)):
        junk = rng.choice(('<div class="comment-list">{}</div>', "<aside>{}</aside>", "<div id=ad>{}</div>", "<form>{}</form>", "<script>{}</script>", "<!-- {} -->", "<div class='cookieNotice'>{}</div>"))
        blocks.insert(rng.randint(1, len(blocks)), junk.format(prose(30)))
    story = "".join(blocks)
    shape = rng.randrange(3)
    if shape == 0:
        story = f"<article><header>{'<h1>Own title</h1>'}</header>{story}</article>"
        want.insert(0, "Own title")
    elif shape == 1:
        story = f'<div class="post-body related-work">{story}</div>'
    else:
        story = f"<section><div>{story}</div></section>"
    page = f"<html><head><title>{prose(3)}</title></head><body><div id=wrap><nav>{links()}</nav>{links()}{story}<div>{links()}</div><footer>{prose(20)}</footer></div></body></html>"
    return page, "\n".join(want)


def test_generated_pages():
    rng = random.Random(2)
    for _ in range(150):
        page, want = generated(rng)
        assert html_text.main_text(page) == want


def test_time_grows_with_the_page():
    for page in ("<div>{0}" + "</x>{0}", '<a href="{0}', "<b>{0}<p>x</p>{0}", "<table>{0}<td>{0}x</b>{0}", "<!--{0}", "<b>{0}<li>x{0}"):
        times = []
        for n in (4_000, 16_000):
            text = "".join(x * n for x in page.split("{0}"))
            began = time.process_time()
            html_text.main_text(text)
            times.append(time.process_time() - began)
        assert times[1] < 10 * times[0] + 0.2


def test_rows_of_all_kinds(spark):
    page = "<p>" + "a long text &amp; more " * 30_000 + "</p>"
    rows = [(1, "u", "<p>x", 5), (1, "u", "<p>x", 5), (2, None, None, 5), (None, "v", "", 5), (3, "w", page, 5), (4, "w", " <br> &nbsp; <script>x", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int").withColumn("n_chars", html_text.F.lit(3))
    got = sorted(map(tuple, html_text.extract(df).collect()), key=str)
    long = " ".join("a long text & more".split() * 30_000)
    assert got == sorted([(1, "u", "x", 1), (1, "u", "x", 1), (2, None, "", 0), (None, "v", "", 0), (3, "w", long, len(long)), (4, "w", "", 0)], key=str)
    assert html_text.extract(df.limit(0)).count() == 0
