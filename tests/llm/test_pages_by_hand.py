"""Operator 9 on pages written by hand: other shapes than those that the model learns from, and odd tables."""

import pytest

from colframe.llm import html

PARAGRAPHS = [f"The river rose for the {n} time this year, and the farmers of the lower valley moved their cattle to the hills before the water reached the barns." for n in ("first", "second", "third", "fourth")]
MENU = "<div class='nav menu'><ul>" + "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in ("home", "news", "sport", "about", "contact")) + "</ul></div>"
FOOTER = "<div class='footer'><a href='/terms'>Terms</a> | <a href='/privacy'>Privacy</a> &copy; 2020</div>"
SHAPES = {
    "article": "<nav>{menu}</nav><article><h1>Flood</h1>{body}</article><footer>{footer}</footer>",
    "main": "<header>{menu}</header><main><h1>Flood</h1>{body}</main>{footer}",
    "divs": "{menu}<div id='wrap'><div class='content'><div class='story-body'><h1>Flood</h1>{body}</div></div></div>{footer}",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_shapes(spark, shape):
    body = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    page = f"<html><body>{SHAPES[shape].format(menu=MENU, body=body, footer=FOOTER)}</body></html>"
    [row] = html.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).collect()
    assert all(p in row.text.split("\n") for p in PARAGRAPHS) and "Privacy" not in row.text and "contact" not in row.text


def test_fallbacks_and_formulas_are_text():
    root = html.parse("<p>Where <math><mi>x</mi></math> is a value, <object>fallback</object> is <noscript>plainly</noscript> shown<svg><text>drawn</text></svg>.</p>")
    found = []

    def walk(n):
        if n.text is not None and (t := html.block_text(n)):
            found.append(t)
        for c in n.children:
            walk(c)

    walk(root)
    assert found == ["Where x is a value, fallback is plainly shown."]


def test_odd_tables(spark):
    """No rows, repeated rows, a very long block, and extra columns with names that operators use inside."""
    long = "<article><h1>T</h1><p>" + "word and more of the text. " * 40_000 + "</p></article>"
    page = "<html><body><article><h1>Title</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS) + "</article></body></html>"
    df = spark.createDataFrame([(1, "u", page, "x", 1), (1, "u", page, "x", 1), (2, None, long, "y", 2), (None, "v", None, "z", 3)], "page_id long, url string, html string, text string, n_chars int")
    out = html.extract(df).collect()
    assert len(out) == 4 and html.extract(df.limit(0)).count() == 0
    by_id = {r.page_id: r for r in out}
    assert len({r.text for r in out if r.page_id == 1}) == 1 and by_id[None].text == "" and by_id[None].n_chars == 0
    assert by_id[2].n_chars == len(by_id[2].text) >= 27 * 40_000 - 1
