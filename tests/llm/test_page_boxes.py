"""Page extraction: what attributes say of boxes, lists within text, and smoothing and threshold against a plain table."""

import random

import pytest

from allelica.llm import html_extract

PROSE = "Some prose, here, that goes on and on."
LINKS = "<ul><li><a href='x'>one</a></li><li><a>two</a></li><li><a>three</a></li></ul>"


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<div title='Hidden gems, display: none'><p>Gems.</p></div>", "Gems."),
        ("<div data-id='menu' data-class='ads'><p>Kept, yes.</p></div>", "Kept, yes."),
        ("<div hidden><p>no</p></div><div style='top:0;display : none'>no</div><div aria-hidden=true>no</div><div ID=menu>no</div>", ""),
        (LINKS, "one\ntwo\nthree"),
        ("<h3>Related</h3>" + LINKS, "Related"),
    ],
)
def test_boxes_inside_an_article(inner, want):
    page = f"<body><nav>{LINKS}</nav><article><p>{PROSE}</p>{inner}<p>More of this, at last.</p></article></body>"
    assert html_extract.main_text(page) == "\n".join(t for t in (PROSE, want, "More of this, at last.") if t)


def test_list_of_links_behind_the_text():
    assert html_extract.main_text(f"<article><p>{PROSE}</p>{LINKS}</article>") == PROSE


def test_names_alone_never_empty_a_page():
    inner = f"<h1>Title</h1><p>{PROSE}</p>"
    assert html_extract.main_text(f"<nav>x</nav><div class='comment'>{inner}</div>") == f"Title\n{PROSE}"
    assert html_extract.main_text(f"<div class='comment'>no, not this.</div><div>{inner}</div>") == f"Title\n{PROSE}"
    assert html_extract.main_text("<nav>x</nav><footer>y</footer>") == ""


def boxes(rng, depth):
    """A random tree of boxes: (tag, number of paragraphs, boxes inside)."""
    inner = [boxes(rng, depth - 1) for _ in range(rng.randint(0, 3))] if depth else []
    return rng.choice(["div", "section", "div", "article"]), rng.randint(0, 3), inner


def markup(box):
    tag, n, inner = box
    return f"<{tag}>" + f"<p>{PROSE}</p>" * n + "".join(map(markup, inner)) + f"</{tag}>"


@pytest.mark.parametrize("seed", range(12))
def test_smoothing_and_threshold(seed):
    """Of each box: paragraphs by the ratio of its path, shares of boxes around, below and beside it, the article's
    factor; content from a share of the best box's weight without that factor on."""
    rng = random.Random(seed)
    root = ("div", 1, [boxes(rng, 3) for _ in range(3)])
    ratio = float(len(PROSE) * (1 + sum(c in ".,;:!?" for c in PROSE)))
    table = []  # own, around, below, beside, in article

    def walk(box, around, beside, article):
        tag, n, inner = box
        article = article or tag == "article"
        table.append((n * ratio, around, sum(x[1] for x in inner) * ratio, beside, article))
        for k, x in enumerate(inner):
            walk(x, n * ratio, sum(y[1] for j, y in enumerate(inner) if j != k) * ratio, article)

    walk(root, 0.0, 0.0, False)
    page = html_extract.Page(markup(root))
    got = html_extract.smoothed(page, html_extract.ratios(page)[0])[1:]
    want = [(own + 0.25 * (around + below) + 0.0625 * beside) * (6 if article else 1) for own, around, below, beside, article in table]
    assert got == pytest.approx(want)
    least = 0.3 * max(w / (6 if t[4] else 1) for w, t in zip(want, table, strict=True) if t[0])
    kept = sum(round(t[0] / ratio) for w, t in zip(want, table, strict=True) if w >= least)
    assert html_extract.main_text(markup(root)).split("\n") == [PROSE] * kept
