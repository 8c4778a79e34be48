"""Article text outside the largest element."""

import math

import numpy as np
import pytest

from segrules.llm import html_extract
from segrules.llm.html_extract import main_text, smoothed

LONG = "".join(f"<p>{'The long part of the article goes on and on here. ' * 8}{i}</p>" for i in range(6))
LINKS = "<div class=menu>" + "".join(f"<a href=/{i}>Go {i}</a>" for i in range(9)) + "</div>"


@pytest.mark.parametrize(
    "html, whole",
    [
        (f"<body>{LINKS}<div id=content><h1>Title</h1><p>Lead</p><div class=body>{LONG}</div><p>By A.</p></div></body>", ["Title", "Lead", "By A."]),
        (f"<body>{LINKS}<div id=content><div><h1>Title</h1></div><div>{LONG}</div></div></body>", ["Title"]),
        (f"<body>{LINKS}<div><article>{LONG}</article><article><h2>Part two</h2><p>The end.</p></article></div></body>", ["Part two", "The end."]),
        (f"<body>{LINKS}<main><h1>Title</h1><article>{LONG}</article></main></body>", ["Title"]),
        (f"<h1>Title</h1>{LONG}<p>Short.</p>{LONG}", ["Title", "Short."]),
    ],
)
def test_whole_article(html, whole):
    text = main_text(html).split("\n\n")
    assert [x for x in whole if x in text] == whole
    assert sum(x.startswith("The long") for x in text) in (6, 12)
    assert not any("Go 1" in x for x in text)


@pytest.mark.parametrize(
    "html, whole",
    [
        (f"<body><article><h2 id=related-work>Related work</h2><p>One.</p><h2 id=social-impact>Impact</h2>{LONG}</article></body>", ["Related work", "One.", "Impact"]),
        (f"<body><article>{LONG}<section id=legal-history><h2>Law</h2><p>Old.</p></section></article></body>", ["Law", "Old."]),
        (f"<body>{LINKS}<h1>Title</h1><p>Lead</p><article>{LONG}</article></body>", ["Title", "Lead"]),
        (f"<body><form action=/>{LINKS}<div><h1>Title</h1>{LONG}</div><input name=q></form></body>", ["Title"]),
        (f"<body><main>{LONG}</main><main><h2>Two</h2><p>More.</p></main></body>", ["Two", "More."]),
    ],
)
def test_names_titles_forms_and_second_mains(html, whole):
    text = main_text(html).split("\n\n")
    assert [x for x in whole if x in text] == whole
    assert sum(x.startswith("The long") for x in text) == 6
    assert not any("Go 1" in x for x in text)


@pytest.mark.parametrize(
    "part",
    [
        "<form><p>Your mail address</p><input></form>",
        "<section id=comments><p>First!</p></section>",
        "<div class=related-posts><p>Read on</p></div>",
        "<aside><p>Aside</p></aside>",
        "<div id=newsletter><p>Sign up</p></div>",
    ],
)
def test_boilerplate_in_an_article_goes(part):
    assert main_text(f"<article>{LONG}{part}</article>") == main_text(f"<article>{LONG}</article>")


def test_content_lines_decide_on_the_region(monkeypatch):
    """A main of many links holds more text than the story beside it, but hardly a content line."""
    tools = "".join(f"<div><span><b><i><a href=/{i}>A link to another page of this place, number {i}</a></i></b></span></div>" for i in range(90))
    story = f"<div><h1>Title</h1><p>By A.</p><p>Monday</p><p>Lead</p>{LONG}</div>"
    html = f"<body><main>{tools}</main>{story}</body>"
    assert main_text(html) == main_text(f"<article>{story}</article>")
    monkeypatch.setattr(html_extract, "content_lines", lambda lines: [True] * len(lines))
    assert "A link" in main_text(html)


def test_smoothing_by_brute_force():
    ratios = np.array([3.0, 0.0, 40.0, 41.5, 2.0, 7.0, 90.0])
    for sigma in (1.0, 2.0):
        radius = max(1, int(3 * sigma))
        for i, got in enumerate(smoothed(ratios, sigma)):
            near = [(math.exp(-0.5 * ((j - i) / sigma) ** 2), x) for j, x in enumerate(ratios) if abs(j - i) <= radius]
            assert math.isclose(got, sum(w * x for w, x in near) / sum(w for w, _ in near))


def test_a_very_long_page():
    page = "<body><article>" + "<p>Short words of a long page.</p>" * 60_000 + "<div>" * 2_000 + "<p>Deep.</p></article></body>"
    text = main_text(page).split("\n\n")
    assert len(text) == 60_001 and text[-1] == "Deep."
