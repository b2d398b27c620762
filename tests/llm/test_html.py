"""Main text against sites whose articles are known, against a plain reader of the given pages, and on deep pages."""

import html.parser
import random
import time

import pyarrow.parquet as pq
import pytest

from stridelake.llm import html_text

LONG = "A sentence of the article, with commas, and a full stop. "


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


class Article(html.parser.HTMLParser):
    """The blocks of the article element, for pages whose paragraphs are all closed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.now = 0, [], ""

    def flush(self):
        if text := " ".join(self.now.split()):
            self.out.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag == "br":
            self.now += " "
        elif tag not in ("a", "b"):
            self.flush()

    def handle_endtag(self, tag):
        if tag not in ("a", "b"):
            self.flush()
        self.inside -= tag == "article"

    def handle_data(self, data):
        self.now += data if self.inside else ""


def test_given_pages():
    for page in pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist():
        reader = Article()
        reader.feed(page)
        assert html_text.main_text(page) == "\n\n".join(reader.out)


JUNK = ["user-comments", "comment-list", "cookie-bar", "ad-slot", "site-footer", "newsletter-signup", "site-header", "relatedLinks", "widget social-share", "gdpr", "sidebar-inner"]


@pytest.mark.parametrize("name", JUNK)
@pytest.mark.parametrize("body", ["<article>{}</article>{}", "<article>{}{}</article>", "<main>{}{}</main>", "<div class=page><div class=text>{}</div>{}</div>"])
def test_marked_parts_go(name, body):
    junk = f'<div class="{name}"><p>{LONG * 2}</p><div><article><p>Another sentence, of a reader.</p></article></div></div>'
    page = f"<body>{body.format(f'<h1>Head</h1><p>{LONG * 3}</p><ul><li>short</li><li><a href=x>link</a></li></ul><p>End, of it.</p>', junk)}</body>"
    assert html_text.main_text(page) == f"Head\n\n{(LONG * 3).strip()}\n\nshort\n\nlink\n\nEnd, of it."


def test_generated_sites():
    """Sites of four layouts: every article block comes back, nothing else does."""
    rng = random.Random(12)
    for case in range(300):
        inner, want = "", []
        for _ in range(rng.randint(2, 12)):
            text = words(rng, rng.randint(8, 60))
            kind = rng.choice(["p", "p", "p", "h2", "ul", "quote", "div"])
            if kind == "ul":
                items = [words(rng, rng.randint(2, 9)) for _ in range(3)]
                inner += "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
                want += items
            elif kind == "h2":
                inner += f"<h2>{text[:30].strip()}</h2><p>{text}</p>"
                want += [text[:30].strip(), text]
            else:
                inner += {"p": f"<p>{text}</p>", "quote": f"<blockquote><p>{text}</p></blockquote>", "div": f"<div class=para>{text}</div>"}[kind]
                want.append(text)
        first, last = words(rng, 60), words(rng, 60)
        inner, want = f"<h1>The title</h1><p>{first}</p>{inner}<p>{last}</p>", ["The title", first, *want, last]
        menu = "".join(f"<li><a href=/{k}>Page {k}</a></li>" for k in range(rng.randint(2, 9)))
        top = rng.choice([f"<nav>{menu}</nav>", f"<ul class=x1>{menu}</ul>", f"<div><ul>{menu}</ul></div>", f'<div class="main-menu">{menu}</div>'])
        thread = "".join(f"<div class=c><b>reader{k}</b><p>{words(rng, 20)}</p></div>" for k in range(rng.randint(1, 5)))
        comments = rng.choice(["", f'<div id="comments">{thread}</div>', f"<section><h3>{rng.randint(1, 9)} comments</h3>{thread}</section>", f'<ol class="comment-list">{thread}</ol>'])
        foot = rng.choice(["<footer><p>All rights reserved, by the host.</p></footer>", '<div class="site-footer"><p>All rights reserved, by the host.</p></div>'])
        layout = ["<article>{}</article>", "<main><article>{}</article></main>", "<div class=wrap><div class=post>{}</div></div>", "<table><tr><td><div>{}</div></td></tr></table>"][case % 4]
        assert html_text.main_text(f"<html><body>{top}{layout.format(inner)}{comments}{foot}</body></html>") == "\n\n".join(want), case


def test_content_beside_an_article_stays():
    article, section = (LONG * 9).strip(), (LONG * 6).strip()
    page = f"<body><nav>menu</nav><article><p>{article}</p></article><section><h2>More</h2><p>{section}</p></section><div class=x>tiny</div></body>"
    assert html_text.main_text(page) == f"{article}\n\nMore\n\n{section}"


def test_comments_hold_articles():
    page = f"<body><div class=post><p>{LONG}</p><p>{LONG}</p></div><div class=comments><article><p>{LONG * 9}</p></article></div></body>"
    assert html_text.main_text(page) == f"{LONG.strip()}\n\n{LONG.strip()}"
    page = f"<body><article><p>{LONG}</p><h2>Comments</h2><p>A comment starts with a hash, in this language.</p></article></body>"
    assert html_text.main_text(page).endswith("Comments\n\nA comment starts with a hash, in this language.")


@pytest.mark.parametrize("odd", ["<div>", "<div>a", "<span>x", "<li>x", "<p>a", "<a href=x>b", "<div class=ad>", "<article>", "<section class=comments>a", "<span></i>x"])
def test_time_is_linear_in_depth(odd):
    assert html_text.main_text(f"<p>{LONG}</p>" + odd * 1000).startswith(LONG.strip()) or odd != "<div>"
    took = []
    for n in (12_500, 100_000):
        begun = time.process_time()
        html_text.main_text(f"<p>{LONG}</p>" + odd * n)
        took.append(time.process_time() - begun)
    assert took[1] < 8 * 3 * took[0] + 0.5


def test_long_page():
    para = f"<p>{LONG}</p>"
    begun = time.process_time()
    got = html_text.main_text(f"<body><article>{para * 40_000}</article></body>")
    assert got.count("\n\n") == 39_999 and time.process_time() - begun < 10
