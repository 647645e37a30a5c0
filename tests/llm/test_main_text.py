"""Operator 5 on made pages whose article is known, and on hostile ones."""

import html
import random
import re
import time
from collections import Counter

import pytest

from granary.llm import html_text

WORDS = "river meadow spring village market hill season water bridge stone boat mill winter road valley garden house door window letter story page cookie copyright market share".split()
PARAGRAPHS = "<p>The river rose over the meadows in spring, and the village moved its market to the hill for a season.</p><p>Short.</p><p>Then the water fell, and the old bridge was found to stand where it had always stood before.</p>"
ARTICLE = "A flood The river rose over the meadows in spring, and the village moved its market to the hill for a season. Short. Then the water fell, and the old bridge was found to stand where it had always stood before."


def sentence(r, low, high):
    return " ".join(r.choice(WORDS) for _ in range(r.randrange(low, high))).capitalize() + "."


def made_page(seed):
    """(html, the article's text): menus, notices, promotions, sidebars, forms, comments around and inside an article."""
    r = random.Random(seed)
    title = sentence(r, 3, 8)[:-1]
    paragraphs = [sentence(r, 12, 60) if r.random() < 0.8 else sentence(r, 1, 6) for _ in range(r.randrange(4, 14))]
    body = [f"<h1>{title}</h1>"] + [f"<p>{html.escape(p)}" + "</p>" * r.randrange(2) for p in paragraphs]
    body.insert(r.randrange(3, len(body)), f'<div class="{r.choice(["ad", "sponsored", "promo-box", "advert"])}">{sentence(r, 6, 14)}</div>')
    box = r.choice(['<article class="post">{}</article>', '<main>{}</main>', '<div class="more-story">{}</div>', '<div>{}</div>', '<div id="content"><div class="text-popular">{}</div></div>', '<section>{}</section>'])
    menu = "".join(f"<li><a href=/{k}>{r.choice(WORDS)}</a></li>" for k in range(r.randrange(3, 9)))
    top = r.choice([f"<nav><ul>{menu}</ul></nav>", f'<div class="navbar"><ul>{menu}</ul></div>', f"<header><ul>{menu}</ul></header>"])
    notice = r.choice(["", '<div class="cookie-notice">We use cookies on this site.</div>', '<div role="dialog" class="consent-modal"><p>We value your privacy and use cookies.</p><button>Accept</button></div>'])
    side = r.choice(["", f'<aside><h3>Related</h3><ul>{menu}</ul></aside>', f'<div class="sidebar"><ul>{menu}</ul></div>'])
    form = r.choice(["", "<form class=newsletter><label>Mail<input></label><p>Sign up for our letter.</p><button><div>Go</div></button></form>"])
    talk = r.choice(["", '<section id="comments">' + "".join(f'<div class="comment"><p>{sentence(r, 5, 20)}</p></div>' for _ in range(3)) + "</section>"])
    foot = r.choice(["<footer>&copy; 2024 Village news</footer>", '<div class="footer"><a href=/>Home</a> &copy; 2024</div>'])
    page = f"<html><head><title>{title} | News</title><style>p{{}}</style></head><body>{top}{notice}<script>var t='</p>';</script>{box.format(''.join(body))}{side}{form}{talk}{foot}"
    return page, " ".join([title, *paragraphs])


def f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values()))


def test_made_pages():
    """Mean token F1 0.98 and more; the cut overrules the classifier on some pages, and does not do worse than it."""
    scores, alone, overruled = [], [], 0
    for seed in range(300):
        page, want = made_page(seed)
        blocks, odds, side = html_text.labelled(page)
        scores.append(f1(" ".join(b.text for b, s in zip(blocks, side, strict=True) if s), want))
        alone.append(f1(" ".join(b.text for b, o in zip(blocks, odds, strict=True) if o > 0), want))
        overruled += any(s != (o > 0) for s, o in zip(side, odds, strict=True))
    assert sum(scores) / 300 > 0.98 and sum(scores) >= sum(alone) and overruled > 30, (sum(scores) / 300, sum(alone) / 300, overruled)


def test_table_pages(spark, sf):
    """The pages of the table hold their article in one element."""
    overruled = 0
    for row in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/pages.parquet").collect():
        blocks, odds, side = html_text.labelled(row.html)
        overruled += any(s != (o > 0) for s, o in zip(side, odds, strict=True))
        inside = re.search("<article>(.*)</article>", row.html, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inside))).split())
        assert " ".join(b.text for b, s in zip(blocks, side, strict=True) if s) == want


def test_no_feature_outweighs_the_edges():
    h = html_text
    assert max(h.LONG, h.LINKS, h.OUTSIDE, h.INSIDE, h.TITLE, h.RIGHTS, h.HIDDEN, h.FURTHER, *h._TAGS.values(), h._says("div", "ad")[0]) < h.FULL_EDGES


@pytest.mark.parametrize("box", ['<div class="more-story">', '<div class="text-popular">', '<div class="ad">', "<nav>", "<div id=sidebar-layout>"])
def test_a_name_alone_does_not_lose_an_article(box):
    page = f"<nav><a href=/>Home</a></nav>{box}<article><h1>A flood</h1>{PARAGRAPHS}</article></div></nav><footer>&copy; 2024 Village news</footer>"
    assert html_text.main_text(page) == ARTICLE


@pytest.mark.parametrize("tag", ["label", "select", "button", "object", "textarea", "svg", "noscript"])
def test_unclosed_controls_hide_nothing(tag):
    for before in (f"<form><{tag}>Mail<input></form>", f"<{tag}>Mail"):
        assert html_text.main_text(f"<nav><a href=/>Home</a></nav>{before}<article><h1>A flood</h1>{PARAGRAPHS}</article><footer>&copy; 2024 Village news</footer>") == ARTICLE
    assert "Hush" not in html_text.main_text(f"<article><h1>A flood</h1><{tag}><p>Hush, said the river to the meadow and to the mill.</p></{tag}>{PARAGRAPHS}</article>")


def test_long_and_deep_pages():
    began = time.time()
    assert html_text.main_text("<div>" * 100_000 + PARAGRAPHS).endswith("stood before.")
    html_text.main_text("<b>" * 50_000 + "<p>x</p></b></section>" * 50_000)
    text = "The river rose over the meadows in spring, and fell. " * 40_000
    assert html_text.main_text(f"<article><p>{text}</p></article>") == text.strip()
    assert time.time() - began < 30
