"""Inline elements with a marking class, id or role end where their end tag stands."""

import pytest

from tessera.llm import html_text

HEAD = "It is the first of the sentences that are in this paragraph"
TAIL = "and this is the rest of it, which is as long as the first part was."


@pytest.mark.parametrize("inline", ["<span class=share>Share</span>", '<a class="related" href=#>More</a>', "<i id=ad>Buy</i>", '<b role="navigation">Menu</b>', "<span class=share>a <span>b</span> c <span class=x>d</span> e</span>"])
@pytest.mark.parametrize("frame", ["<article><p>{}</p><p>{}</p></article>", "<article>{}<p>{}</p></article>", "<div>{}</div><p>{}</p>"])
def test_text_after_an_inline_marked_element_stays(frame, inline):
    page = "<body>" + frame.format(f"{HEAD} {inline} {TAIL}", TAIL)
    assert html_text.main_text(page).split("\n") == [HEAD, TAIL, TAIL]


def test_inline_ends_without_a_marked_element_end_no_block():
    assert html_text.main_text(f"<article><p>{HEAD} <span class=x>of</span> <b>the</b></i> {TAIL}</p></article>") == f"{HEAD} of the {TAIL}"
    assert html_text.main_text(f"<article><p>{HEAD} <span class=share>x</p><p>{TAIL}</p></article>") == f"{HEAD}\n{TAIL}"
