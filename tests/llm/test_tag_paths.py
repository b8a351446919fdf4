import time

import pytest

from risewatch.llm import tag_paths
from risewatch.llm.tag_paths import WORDS, blocks, extract

LONG = "Lorem ipsum dolor sit amet, consectetur adipiscing elit; sed do eiusmod tempor incididunt. "

PAGES = {
    "plain article": (f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Title</h1><p>{LONG}</p><p>Short.</p></article><footer>(c)</footer></body></html>", ["Title", LONG, "Short."]),
    "no article element": (f"<body><div class='menu'>Home About</div><div id='content'><h2>Head</h2><p>{LONG}</p><p>Tail end</p></div><div class='sidebar'><p>{LONG}</p></div></body>", ["Head", LONG, "Tail end"]),
    "comments and adverts inside": (f"<article><p>{LONG}</p><div class=ad>Buy</div><section id=\"comments\"><p>{LONG}</p></section><form><p>Mail</p></form><aside><p>{LONG}</p></aside><p>End.</p></article>", [LONG, "End."]),
    "unclosed markup": (f"<body><article><h1>T</h1><p><b>{LONG}<br><p>Next &amp; last", ["T", LONG, "Next & last"]),
    "raw elements": (f"<article><script>if (a < b) '</p>'</script><style>p{{}}</style><!-- <p>no</p> --><noscript><p>js</p></noscript><p>{LONG}</p></article>", [LONG]),
    "references and space": (f"<main><p> caf&eacute;\n\t &#x26; &nbsp;tea{LONG}</p><pre>a\n  b</pre></main>", ["café & tea" + LONG, "a b"]),
    "inline markup": (f"<article><p>one <em>two</em>, <a href='x'>three</a>{LONG}</p></article>", ["one two, three" + LONG]),
    "cookie notice": (f"<body><div class='cookie-notice'><p>{LONG}</p></div><div><p>{LONG}</p><p>More, and more.</p></div></body>", [LONG, "More, and more."]),
    "site header as a division": (f"<body><div id='header'><p>Site, of all sites.</p></div><div><div class='post-header'><h1>T</h1></div><p>{LONG}</p></div></body>", ["T", LONG]),
    "lists and tables": (f"<article><p>{LONG}</p><ul><li>one<li>two</ul><table><tr><td>a<td>b</table></article>", [LONG, "one", "two", "a", "b"]),
    "no text": ("<html><body><nav>Home</nav></body></html>", []),
    "empty": ("", []),
    "none": (None, []),
    "text only": ("just words", ["just words"]),
    "broken": ("<div <p>><<<", None),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages(name):
    page, want = PAGES[name]
    got = extract(page)
    if want is not None:
        assert got == "\n".join(" ".join(x.split()) for x in want)


def test_blocks_know_their_path():
    found = blocks("<div><p>a<b>c</b></p></div>d", frozenset(WORDS))
    assert [(t, path) for t, _, path, _ in found] == [("ac", ("div", "p")), ("d", ())]


def test_deep_and_long_pages():
    assert extract("<div>" * 3000 + LONG + "</div>" * 3000) == LONG.strip()
    assert len(extract("<article>" + f"<p>{LONG}</p>" * 4000 + "</article>").split("\n")) == 4000


PARAGRAPHS = [f"{i}: {LONG}".strip() for i in range(10)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
SIX, FOUR = "".join(f"<p>{p}</p>" for p in PARAGRAPHS[:6]), "".join(f"<p>{p}</p>" for p in PARAGRAPHS[6:])
ITEMS = "".join(f"<li>{p}</li>" for p in PARAGRAPHS[:6])
CELLS = "".join(f"<tr><td>{p}</td></tr>" for p in PARAGRAPHS[:6])
WHOLE = {
    "two parts": f"<body><div id=content><div class=part1>{SIX}</div><div class=part2>{FOUR}</div></div></body>",
    "two sections": f"<body><div><section>{SIX}</section><section><div>{FOUR}</div></section></div></body>",
    "two articles in main": f"<main><article>{SIX}</article><article>{FOUR}</article></main>",
    "two articles": f"<body><article>{SIX}</article><article>{FOUR}</article></body>",
    "list of most": f"<body><div id=content><ul>{ITEMS}</ul>{FOUR}</div></body>",
    "list and short paragraphs outside": f"<body><div id=content><ul>{ITEMS}</ul><div>{FOUR}</div></div></body>",
    "table of most": f"<body><div id=content><table>{CELLS}</table>{FOUR}</div></body>",
    **{f"wrapper {c}": f"<body><nav>Home</nav><div class='{c}'><article>{BODY}</article></div><footer>(c)</footer></body>" for c in ("content has-sidebar", "no-sidebar", "with-menu", "ad-free", "sidebar", "sidebar-left")},
    **{f"wrapper {c}, no article": f"<body><div class='menu'>Home</div><div class='{c}'>{BODY}</div></body>" for c in ("content has-sidebar", "no-sidebar", "with-menu", "ad-free", "sidebar", "sidebar-left")},
    "wrapper of main": f"<body><div class='popup'><main>{BODY}</main></div><div class='sidebar'>{BODY}{BODY}</div></body>",
    "related work": f"<article>{SIX}<section id='related-work'>{FOUR}</section></article>",
    "results": f"<article>{SIX}<div class='search-results-analysis'>{FOUR}</div></article>",
    "longer comments": f"<body><div id=content>{BODY}</div><div class='comments-area'>{BODY}{BODY}</div></body>",
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_articles(name):
    assert extract(WHOLE[name]).split("\n") == PARAGRAPHS


@pytest.mark.parametrize("name", ("ad", "sidebar left", "site-footer", "related-posts", "siteFooter", "post-comments", "nav-menu", "cookie-notice", "widget2"))
def test_names_that_bar(name):
    assert extract(f"<body><div id=content>{BODY}</div><div class='{name}'>{FOUR}</div></body>").split("\n") == PARAGRAPHS


def test_many_open_elements_with_a_name():
    assert extract(f"<article>{BODY}" + "<div class=ad>" * 20_000 + LONG).split("\n") == PARAGRAPHS


@pytest.mark.parametrize("page", ["<a" * 50_000, "<" * 100_000, '<a "' * 25_000, "<a 'x" * 17_000, "<a " * 33_000 + '" > "', "<div" + "A" * 100_000, "<a \"'" * 20_000 + ">", "<script>" + "</script" * 12_000])
def test_unclosed_tags_take_linear_time(page):
    start = time.time()
    blocks(page, frozenset(WORDS))
    assert time.time() - start < 2


def test_tags_with_quotes_and_without_an_end():
    text = lambda page: [b[0] for b in blocks(page, frozenset())]
    assert text("<p title='a > b'>one</p><p>1 < 2</p>") == ["one", "1 < 2"]
    assert text("<p>a <b c</p>") == ["a"]  # the tag goes on to the first >
    assert text("<p>a <b 'c</p>") == ["a <b 'c"]
    assert text("a<!-- <p>x</p> -->b<!-- open") == ["ab"]
    assert text("<style>p > a {}</style >kept<script>x") == ["kept"]


MENU = "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul>"
SELECTED = {
    "menu and copyright without names": f"<body><div id=top1>{MENU}</div><div><h1>Head</h1>{BODY}<p>Short</p></div><div id=bot>Copyright 2020, all rights reserved.</div></body>",
    "inside an article": f"<article><h1>Head</h1><div>{MENU}</div>{BODY}<p>Short</p><div>Posted in: news</div></article>",
    "heading in a container": f"<article><div><h1>Head</h1></div><div>{BODY}<p>Short</p></div><div><h2>More</h2>{MENU}</div></article>",
    "cell of a layout table": f"<table><tr><td>{MENU}</td><td><h1>Head</h1>{BODY}<p>Short</p></td></tr></table>",
    "header of an article": f"<header><h1>Site</h1></header><article><header><h1>Head</h1><p>By A. Writer</p></header>{BODY}<p>Short</p></article>",
    "comments of users": f"<article><h1>Head</h1>{BODY}<p>Short</p><div class=user-comments>{FOUR}</div><div id=c-thread>{FOUR}</div></article>",
}


@pytest.mark.parametrize("name", SELECTED)
def test_ratios_select_containers(name):
    assert extract(SELECTED[name]).split("\n") == ["Head", *PARAGRAPHS, "Short"]


def test_flat_scores_change_the_result(monkeypatch):
    got = [extract(page) for page in SELECTED.values()]
    monkeypatch.setattr(tag_paths, "path_scores", lambda found, radius=1: {b[2]: 1.0 for b in found if not b[3]})
    assert [a != extract(page) for a, page in zip(got, SELECTED.values())] == [True] * 5 + [False]


def test_short_cells_of_a_data_table_stay():
    table = "".join(f"<tr><th>{i}</th><td>x</td></tr>" for i in range(5))
    assert extract(f"<article>{BODY}<table>{table}</table></article>").split("\n") == [*PARAGRAPHS, *(x for i in range(5) for x in (str(i), "x"))]


def test_formulas_and_drawings():
    page = f"<article><p>As <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> and <svg><title>icon</title><path d='M0'/><text>mark</text></svg> show: {LONG}</p></article>"
    assert extract(page) == f"As x=1 and mark show: {LONG}".strip()


def test_path_scores_like_a_plain_walk():
    found = [("a, b.", (1,), ("p",), ()), ("c" * 9, (2,), ("li",), ()), ("d, " * 9, (3,), ("p",), ()), ("e", (4,), ("nav",), ((4, 1),))]
    e = 2.718281828459045**-2
    ratios = {"p": ((5 + 27) / 2, (2 + 9) / 2), "li": (9.0, 0.0)}
    order, want = ["p", "li", "p"], {"p": 1.0, "li": 1.0}
    for k in (0, 1):
        r = [ratios[x][k] for x in order]
        v = [(r[i] + e * (r[max(i - 1, 0)] + r[min(i + 1, 2)])) / (1 + 2 * e) for i in range(3)]
        own = {"p": (v[0] + v[2]) / 2, "li": v[1]}
        want = {x: want[x] * own[x] * 2 / sum(own.values()) for x in own}
    assert tag_paths.path_scores(found) == pytest.approx({(x,): y for x, y in want.items()})
