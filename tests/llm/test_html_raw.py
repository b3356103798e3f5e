import pytest

from adlift.llm.html_text import blocks, features, is_main, trained


@pytest.mark.parametrize("tag", ["<svg class='x' />", "<svg/>", "<svg><path d='m'>", "<select><option>one", "<div><canvas>no canvas</div>",
                                 "<div><object>no object</div>", "<svg><path></svg>", "<select><option>one</select>"])
def test_text_after_it_stays(tag):
    tree = trained()
    found = blocks(f"<article><p>First words of it.</p>{tag}<p>Last words of it.</p></article>")
    assert " ".join(b[0] for b, r in zip(found, features(found), strict=True) if is_main(tree, r)) == "First words of it. Last words of it."


def test_scripts_last_to_the_end():
    assert [b[0] for b in blocks("<p>a</p><script>x <p>b</p>")] == ["a"]
