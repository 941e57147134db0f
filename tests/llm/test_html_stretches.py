"""Pages that mark no article or main, their body cut by boilerplate."""

import pytest

from tessera.llm import html_text

AD = '<div class="advert"><p>Buy</p><p>more</p><p>of</p><p>this</p></div>'
LONG = "".join(f"<p>Paragraph {i} of the long part, which goes on and on for quite a while.</p>" for i in range(30))
LEAD, END = "A short lead that stands above the advert.", "The closing paragraph below it."


@pytest.mark.parametrize("page", [
    f"<html><body><h1>Head</h1><p>{LEAD}</p>{AD}{LONG}{AD}<p>{END}</p></body></html>",
    f"<div id=page><div class=content><h1>Head</h1><p>{LEAD}</p>{AD}{LONG}{AD}<p>{END}</p></div></div>",
    f"<body><div class=top><h1>Head</h1><p>{LEAD}</p></div>{AD}<div class=body>{LONG}</div>{AD}<div><p>{END}</p></div></body>",
    f"<body><div><div><h1>Head</h1><p>{LEAD}</p></div></div>{AD}<div><div><h2>One</h2>{LONG}</div></div>{AD}<div><div><h2>Last</h2><p>{END}</p></div></div></body>",
])
def test_short_parts_beside_boilerplate_stay(page):
    got = html_text.main_text(page).split("\n")
    assert got[:2] == ["Head", LEAD] and got[-1] == END and "Buy" not in got and sum(x.startswith("Paragraph") for x in got) == 30


def test_far_short_stretches_go():
    page = f"<body><div><div><p>Imprint</p></div></div>{AD}<div><div>{LONG}</div></div></body>"
    assert "Imprint" not in html_text.main_text(page) and "Paragraph 29" in html_text.main_text(page)


@pytest.mark.parametrize("name", ["legal-form promo-code", "copyright-law", "social-history", "comment-theory x", "adaptive", "share-price"])
def test_names_of_something_else_stay_in_an_article(name):
    page = f'<body><article><h1>Head</h1><p>First.</p><div class="{name}"><p>Kept words.</p></div><p>Last.</p></article></body>'
    assert html_text.main_text(page) == "Head\nFirst.\nKept words.\nLast."


@pytest.mark.parametrize("name", ["ad", "promo", "promo-box", "share-buttons", "sidebarLeft", "newsletter_signup", "x ad", "comments"])
def test_names_of_boilerplate_go(name):
    page = f'<body><article><h1>Head</h1><p>First.</p><div class="{name}"><p>Gone words.</p></div><p>Last.</p></article></body>'
    assert html_text.main_text(page) == "Head\nFirst.\nLast."


def test_formulas_and_unclosed_elements():
    page = "<body><article><p>If <math><mi>x</mi><mo>=</mo><mn>2</mn></math> then.</p><object data=a><p>After it.</p></article></body>"
    assert html_text.main_text(page) == "If x=2 then.\nAfter it."
    assert html_text.main_text("<p>Before.</p><script>var a = 1; <p>no</p>") == "Before."


def test_prose_stays_where_nothing_marks_an_article():
    lead = "This short lead has nine words in all here."
    page = (f"<body><div><p>{lead}</p></div>{AD}{AD}{AD}<div><div><div>{LONG}</div></div></div>"
            "<div><p><a href=x>A whole sentence that is one link to more.</a></p></div></body>")
    got = html_text.main_text(page).split("\n")
    assert got[0] == lead and got[-1] == "A whole sentence that is one link to more."
