"""Main text where marks, names and links mislead."""

import pytest

from lexgrove.llm import html_text

LONG = "A sentence of the story that is long enough to make the text surge, with some words more in it."


def test_the_distribution_chooses_between_marked_elements():
    teasers = "".join(f"<article><p>Teaser {k}, read more about it.</p></article>" for k in range(3))
    story = f"<p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>"
    text = "\n".join([LONG] * 3)
    assert html_text.extract(f"<body><div>{story}</div>{teasers}</body>") == text
    assert html_text.extract(f"<main><article>{story}</article>{teasers}</main>") == text
    assert html_text.extract(f"<body><main>{story}<p>End.</p></main><p>Foot</p></body>") == text + "\nEnd."


def test_names_of_wrappers_lose_no_text():
    story = f"<h1>Title</h1><p>{LONG}</p><p>{LONG}</p>"
    text = "\n".join(["Title", LONG, LONG])
    for name in ("content has-sidebar", "no-header", "post ad-free", "sidebar"):
        assert html_text.extract(f'<body><div class="{name}"><article>{story}</article></div></body>') == text
    assert html_text.extract(f'<article><header class="entry-header"><h1>Title</h1></header><p>{LONG}</p><p>{LONG}</p></article>') == text
    assert html_text.extract(f'<body><div class="site-header">Site</div><div>{story}</div></body>') == text


def test_lines_of_links_between_text_stay():
    see = "See <a href='x'>a long title of another page of this site</a>."
    seen = "See a long title of another page of this site."
    story = f"<p>{LONG}</p><p>{LONG}</p>" + f"<p>{see}</p>" * 3 + f"<p>{LONG}</p><p>{LONG}</p>"
    nav = "<ul>" + "<li><a href='n'>Menu entry</a></li>" * 4 + "</ul>"
    assert html_text.extract(f"<body><div>{nav}</div><div>{story}</div></body>") == "\n".join([LONG, LONG, seen, seen, seen, LONG, LONG])
    anchors = f"<p><a name=top>{LONG}</p><p><a id=b />{LONG}</p><p>{LONG}</p>"
    assert html_text.extract(f"<body><div>{anchors}</div></body>") == "\n".join([LONG] * 3)
    assert html_text.extract(f"<article><p>{see}</p></article>") == seen


def test_asides_in_elements_that_need_no_end_tag():
    story = f"<p>{LONG}</p>{{}}<p>{LONG}</p>"
    text = f"{LONG}\n{LONG}"
    for more in (
        '<p class="advert">BUY</p>', '<p class="advert">BUY', '<ul><li class="related">See more</li></ul>', '<ul><li class="share"><ul><li>x<li>y</ul>z<li class="ad">q</ul>',
        '<table><tr><td class="sidebar">Side</td></tr></table>', '<table><tr><td class="sidebar">Side<tr class="ad"><td>x</td></table>', "<dl><dt class=promo>Now<dd class=promo>or never</dl>",
    ):
        assert html_text.extract(f"<article>{story.format(more)}</article>") == text, more
    assert html_text.extract(f'<article>{story.format("<ul><li class=ad>x<li>An item.</ul>")}</article>') == f"{LONG}\nAn item.\n{LONG}"
    assert html_text.extract(f'<article><p>One <span class="ad">BUY <span>now</span> or <b>never</b></span> line.</p><p class="lead">{LONG}</p></article>') == f"One line.\n{LONG}"


@pytest.mark.parametrize("length", [20, 138, 5000])
def test_an_aside_stays_out_however_long_it_is(length):
    notice = "We use cookies. " * (length // 16 + 1)
    assert html_text.extract(f'<body><div class="cookie-notice"><p>{notice}</p></div><div class="story"><p>Rain fell.</p></div></body>') == "Rain fell."
    assert html_text.extract(f'<body><main><p>Rain fell.</p></main><div class="newsletter">{notice}</div></body>') == "Rain fell."
    # where nothing else has text the name is wrong
    assert html_text.extract(f'<body><div class="sidebar"><p>{notice}</p></div></body>') == notice.strip()
