"""Features of nodes with many attribute tokens and many siblings."""

from colframe.llm import html


def test_all_tokens_count():
    page = "<div class='" + " ".join(f"mt-{i}x" for i in range(30)) + " sidebar'><p>text</p></div>"
    vocabulary = {"sidebar": 0}
    nodes, x = html.features(html.parse(page), vocabulary)
    div, p = (next(i for i, n in enumerate(nodes) if n.tag == t) for t in ("div", "p"))
    own, here = html.NUMBERS + 3 * len(html.FLAGS), html.NUMBERS + 3 * len(html.FLAGS) + 1
    assert x[div, own] == x[div, here] == x[p, here] == 1


def test_siblings_beyond_fifty_are_counted():
    nodes, x = html.features(html.parse("<hr>" + "<ul><li>x</li></ul>" * 60 + "<p>a</p>" * 70), {})
    assert {x[i, 22] for i, n in enumerate(nodes) if n.tag == "p"} == {70}
    assert {x[i, 22] for i, n in enumerate(nodes) if n.tag == "ul"} == {60} and x[0, 22] == 1
