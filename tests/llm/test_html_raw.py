"""Text beside and inside elements that are not scripts."""

from dockmill.llm.html_blocks import leaf_blocks


def texts(page):
    return [t for _, t, _ in leaf_blocks(page)]


def test_text_after_self_closed_and_unclosed_elements_stays():
    assert texts('<svg class="i"/><article><p>Whole article</p></article>') == ["Whole article"]
    assert texts("<svg><svg><path d='x'/></svg></svg><p>after nested</p>") == ["after nested"]
    for name in ("object", "canvas", "noscript", "template", "svg"):
        assert texts(f"<{name}><p>kept</p>") == ["kept"]
        assert texts(f"<article><{name}><p>inside</p></{name}></article><p>after</p>") == ["inside", "after"]


def test_images_do_not_part_a_line():
    assert texts("<p>one <svg viewBox='0 0 1 1'><path d='M0>1'/></svg> two <svg/> three <noscript><img src='a'></noscript>four</p>") == ["one two three four"]


def test_scripts_styles_and_frames_go():
    assert texts("<script>a<p>b</script><style>c</style><iframe>d<p>e</iframe><svg><style>f</style><text>g</text></svg><p>h</p>") == ["g", "h"]
    assert [p for p, t, _ in leaf_blocks("<noscript><p>x</p></noscript>")] == [["noscript", "p"]]
