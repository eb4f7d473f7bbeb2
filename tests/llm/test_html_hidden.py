"""Only an attribute named hidden hides."""

import pytest

from trendloom.llm import html_text


@pytest.mark.parametrize("attributes", ['style="overflow:hidden"', 'aria-hidden="false"', 'data-state="not hidden"', "title='hidden class=ad'", "style=overflow:hidden", 'data-hidden', 'data-x = "a" data-y="> hidden"'])
def test_the_word_in_other_attributes_hides_nothing(attributes):
    assert [b.text for b in html_text.blocks(f"<div {attributes}><p>kept</p></div>")] == ["kept"]
    assert html_text.tag_features("div", " " + attributes)[0] == {html_text.slot("in:div")}


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN", 'hidden=""', "hidden=until-found", 'class="a"hidden', "style='x' hidden", 'a = "b" hidden = "hidden"', "hidden/", "/hidden", 'x="y"/hidden'])
def test_hidden_hides(attributes):
    assert html_text.blocks(f"<div {attributes}><p>gone</p></div>") == []


def test_other_attributes_still_tell():
    slots, hidden = html_text.tag_features("div", ' CLASS=\'side bar\' id = nav role="menu" aria-label="Main menu" data-class="footer"')
    names = {n for n in ("mark:side", "mark:menu", "mark:foot", "word:bar", "word:nav") if html_text.slot(n) in slots}
    assert not hidden and {"mark:side", "mark:menu", "word:bar", "word:nav"} <= names and "mark:foot" not in names
