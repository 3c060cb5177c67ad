"""Windows' sums, surges and dives choose the text; marks and names only weigh."""

import time

import pytest
from geofold.llm import html_text

ADVERTS = "<div class=ad>buy</div>" * 4
LONG = "A sentence of the story that is long enough. " * 6


def page(*stretches):
    return ADVERTS.join("".join(f"<p>{x}</p>" for x in s) for s in stretches)


def test_a_short_closing_part_beside_a_long_body_stays():
    body, closing = ["word " * 100] * 10, ["closing " * 25] * 2
    clean = [" ".join(x.split()) for x in body + closing]
    assert html_text.main_text(page(body, closing)) == "\n\n".join(clean)
    assert html_text.main_text(page(closing, body * 200)).startswith(clean[-1] + "\n\n" + clean[-1])


def test_windowed_sums_choose_stretches_of_pages_without_an_article():
    body = ["a line of some text " * 4]
    assert html_text.main_text(page(["Top of page"], ["Title", *body, "The end."], ["12 May"])) == "Title\n\n" + body[0].strip() + "\n\nThe end."
    assert html_text.main_text(page(["one"], ["two"])) == "one\n\ntwo"


def test_surges_and_dives_by_hand():
    #                        0  1  2   3  4  5   6  7  8  9 10 11  12
    assert html_text.surges([4, 0, 0, 30, 5, 0, 40, 2, 0, 0, 0, 9, 50], 30) == [(3, 8), (11, 13)]
    assert html_text.surges([5, 5, 5], 15) == [(0, 3)] and html_text.surges([5, 5, 4], 15) == [] and html_text.surges([], 1) == []
    assert html_text.window_sums([1, 2, 3, 4]) == [6, 9, 7, 4]


@pytest.mark.parametrize("mark", ["article", "main", "div"])
@pytest.mark.parametrize(
    "extra, kept",
    [
        ("<div class='notice-period'><p>Three months of notice.</p></div>", "Three months of notice."), ("<div class='related-work'>Others wrote on it.</div>", "Others wrote on it."),
        ("<p>With <span class='tags'>tags</span> inside</p>", "With tags inside"), ("<div class='ad'>Buy now</div>", None), ("<div id=reader-comments><p>First! I was here before.</p></div>", None),
        ("<aside>See also</aside>", None), ("<form><p>Your mail</p><input></form>", None), ("<p hidden>never shown</p>", None), ("<div class='cookieNotice'>We use cookies</div>", None), ("<ul><li>a point</li><li>two</li></ul>", "a point\n\ntwo"),
    ],
)
def test_blocks_inside_an_article(mark, extra, kept):
    got = html_text.main_text(f"<html><body><nav><a href=/>Home</a> <a href=/x>X</a></nav><div class=banner><p>Today only</p></div><{mark}><h1>Head</h1><p>{LONG}</p>{extra}<p>{LONG}</p><p>End.</p></{mark}><footer>All rights</footer></body></html>")
    body = " ".join(LONG.split())
    assert got == "\n\n".join(x for x in ("Head", body, kept, body, "End.") if x)


SENTENCES = " ".join(LONG.split())


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<div><p>{LONG}</p><form>Sign up</form><p>Short ending.</p></div>", [SENTENCES, "Short ending."]),
        (f"<div><p>{LONG}</p><aside>See also</aside><p>Short ending.</p></div>", [SENTENCES, "Short ending."]),
        ("<div>" + "".join(f"<section><h2>Head {i}</h2><p>short {i}</p></section>" for i in range(3)) + f"<section><h2>Head</h2><p>{LONG}</p></section></div>", [*(x for i in range(3) for x in (f"Head {i}", f"short {i}")), "Head", SENTENCES]),
        (f"<article><p>First, short.</p></article><article><p>{LONG}</p></article>", ["First, short.", SENTENCES]),
        (f"<div><table><tr><td>a</td><td>1</td></tr><tr><td>b</td><td>2</td></tr></table><p>{LONG}</p></div>", ["a", "1", "b", "2", SENTENCES]),
        (f"<div><p>{LONG}</p><p><a href=/x>The whole last sentence is a link.</a></p></div>", [SENTENCES, "The whole last sentence is a link."]),
        (f"<form action=/><input><div><p>{LONG}</p><p>End.</p></div></form>", [SENTENCES, "End."]),
        (f"<div><p>{LONG}</p><ul><li><a href=/1>One more story</a></li><li><a href=/2>And another one</a></li></ul></div>", [SENTENCES]),
    ],
)
def test_short_parts_of_the_article_stay(page, want):
    """Each as it stands and beside menus and short blocks of other parts of the page."""
    assert html_text.main_text(page) == "\n\n".join(want)
    assert html_text.main_text(f"<body><nav><a href=/>Home</a></nav><div>Top of the page</div>{page}<div><p>Copyright</p></div><footer>Rights</footer></body>") == "\n\n".join(want)


def test_a_story_outside_of_a_marked_teaser_wins():
    assert html_text.main_text(f"<main><p>Teaser</p></main><div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div>") == "\n\n".join(["Title", *[" ".join(LONG.split())] * 2])


def test_long_reader_comments_and_link_lists_go():
    comments = "".join(f"<div class=comment><p>{LONG[:120]}</p></div>" for _ in range(30))
    links = "<ul>" + "".join(f"<li><a href=/{i}>Another story with a long title {i}</a></li>" for i in range(20)) + "</ul>"
    for mark in ("article", "div"):
        got = html_text.main_text(f"{links}<{mark}><p>{LONG}</p><p>{LONG}</p><section id=comments>{comments}</section></{mark}>{links}")
        assert got == "\n\n".join([" ".join(LONG.split())] * 2)


@pytest.mark.parametrize("make", [lambda n: "<b>" * n + "</i>" * n, lambda n: "<i><p>" + "<b>" * n + "</i>" * n, lambda n: "<div>" + "<b>" * n + "<h1></h1>" * n, lambda n: "<div>" * n + "</span>" * n, lambda n: "<p>a</p><nav>b</nav>" * n, lambda n: "<a href=" * n, lambda n: "<!--" * n, lambda n: "<div class='" * n])
def test_time_is_linear(make):
    def took(n):
        start = time.process_time()
        html_text.main_text(make(n))
        return time.process_time() - start

    took(500)
    assert took(16_000) < 24 * max(took(2_000), 0.004) + 0.3
