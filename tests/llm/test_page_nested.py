"""Elements that are skipped as a whole do not take the rest of the page with them."""

from __future__ import annotations

import time

import pytest

from engramlake.llm.html_blocks import blocks

PAGES = {
    "<article><p>one</p><svg class='i'/><p>two</p></article>": ["one", "two"],
    "<p>one <svg class='i' /> two</p><svg><title>t</title><path d=''/></svg><p>three": ["one", "two", "three"],
    "<p>one</p><svg viewBox='0 0 1 1'><path d='x'/><p>two</p><p>three": ["one", "two", "three"],
    "<p>one</p><object data='x'><p>two</p><object data='y'>gone</object><p>three": ["one", "two", "three"],
    "<p>one</p><template><p>two": ["one", "two"],
    "<p>one</p><template><template>a</template>b</template><p>two": ["one", "two"],
    "<p>one</p><svg a='>'><!-- </svg> --><style>x</svg><p>two": ["one", "two"],
    "<p>one</p><svg><script>'</svg>'</script>a</svg><p>two<script>'<svg>'</script><svg/>": ["one", "two"],
    "<p>one</p></svg><p>two</p><SVG><g/></SVG\n><p>three": ["one", "two", "three"],
    "<p>one<svg": ["one"],
    "<p>one<svg-icon>two</svg-icon>": ["one", "two"],
}


@pytest.mark.parametrize("page", PAGES)
def test_nested_elements(page):
    assert [t for t, _, _ in blocks(page)] == PAGES[page]


def test_many_unclosed_elements():
    start = time.monotonic()
    assert len(blocks("<p>a<svg><object><template><script>" * 20_000)) == 1
    assert len(blocks("<p>a<svg><object><template>" * 20_000)) == 20_000
    assert time.monotonic() - start < 20
