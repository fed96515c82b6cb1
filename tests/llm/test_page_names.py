"""Names of a page's state are not furniture of its blocks."""

from __future__ import annotations

from engramlake.llm import html_extract
from engramlake.llm.html_blocks import blocks

SITES = [
    ("<body class='no-sidebar'><nav>Home</nav><article><p>One.</p></article><div class=sidebar>S</div>", "One."),
    ("<body><nav>Home</nav><div class='content-with-sidebar'><article><p>One.</p><p>Two.</p></article></div><div class=ads>S</div>", "One. Two."),
    ("<body><nav>Home</nav><article class='post comments-open'><h1>Head</h1><p>One.</p><div class=share>Tell</div></article>", "Head One."),
    ("<body><article><p>One.</p><section id='legal-history'><p>Two laws.</p></section></article><div class=legal>L</div>", "One. Two laws."),
    ("<html class=search><body class='sidebar'><div class='sidebar'><main id=search><p>One.</p><p>Two.</p></main></div><div class='site-footer'>S</div>", "One. Two."),
    ("<body class=no-sidebar><div id=page class='content-with-sidebar'><p>One two three.</p><section id=legal-history><p>Four.</p></section></div><div class='primary-sidebar'><p>Side</p></div>", "One two three. Four."),
    ("<body><main class='tags'><article class='post comment'><p>One two.</p></article><div class=related-posts><article><p>More</p></article></div></main>", "One two."),
]


def test_names_of_the_page_are_no_furniture(spark, pages):
    for page, want in SITES:
        found = blocks(page)
        assert " ".join(b[0] for b, main in zip(found, html_extract.labels_of([p for _, p, _ in found]), strict=True) if main) == want
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html").collect()]
    rows += [(-1 - k, "u", page) for k, (page, _) in enumerate(SITES)]
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages(rows)).collect()}
    assert [got[-1 - k] for k in range(len(SITES))] == [want for _, want in SITES]


def test_furniture_names():
    for name in ("sidebar", "site-footer", "cookie-notice", "comment-12", "ad_box", "menu-item-7", "related-posts", "social-icons", "page-header"):
        assert html_extract.furniture_words(name), name
    for name in ("no-sidebar", "content-with-sidebar", "comments-open", "legal-history", "has-header-image", "content-sidebar-wrap", "post", "12", ""):
        assert not html_extract.furniture_words(name), name
