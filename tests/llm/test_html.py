"""Main text of pages that mislead by names or are broken."""

import time

import pytest

from vellumine.llm.html_extract import extract

P = "This is the text of the page and it has as many of the small words as one would like to have in it, so that it is in. "
PROSE, MORE = (P * 3).strip(), (P * 2).strip()
CHINESE = "这是一个关于城市历史的文章，它讲述了许多年前人们的生活。" * 6


@pytest.mark.parametrize("name", ["elementor-widget-container", "content no-sidebar", "has-sidebar", "search-results-article", "ad-hoc"])
def test_wrappers_named_like_boilerplate_keep_the_text(name):
    page = f"<body><nav><a href=1>Menu</a></nav><div class='{name}'><h1>H</h1><p>{PROSE}</p><p>{MORE}</p></div><footer>foot</footer></body>"
    assert extract(page) == f"H\n\n{PROSE}\n\n{MORE}"


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><form id=f><article><p>{PROSE}</p></article></form></body>", PROSE),
        (f"<body><nav><a href=1>菜单</a></nav><div><p>{CHINESE}</p><p>{CHINESE}</p></div><div><a href=2>关于我们</a></div></body>", f"{CHINESE}\n\n{CHINESE}"),
        (f"<body><article><h1>H</h1><p>{PROSE}</p></article><section><article class='comment'><p>{MORE}</p></article></section></body>", f"H\n\n{PROSE}"),
        (f"<body><main><article><p>{PROSE}</p><p>{PROSE}</p></article><article class='comment'><p>{MORE}</p></article></main></body>", f"{PROSE}\n\n{PROSE}"),
        (f"<body><main><header class='site-header'><a href=/>Home</a> The Site Name</header><article><h1>H</h1><p>{PROSE}</p></article></main></body>", f"H\n\n{PROSE}"),
        (f"<head><style media='x>p {{ color: red }}</style></head><body><p>{PROSE}</p></body>", PROSE),
        (f"<body><p class='hidden-xs'>{PROSE}</p><p title='a hidden gem'>{MORE}</p></body>", f"{PROSE}\n\n{MORE}"),
        (f"<body><p hidden>{PROSE}</p><p>{MORE}</p><SCRIPT>var a = '</p>';</Script ></body>", MORE),
        (f"<body><p data-x='a > b'>{PROSE}</p><p>1 < 2 &lt; 3</p><p>{MORE}</p>", f"{PROSE}\n\n1 < 2 < 3\n\n{MORE}"),
        (f"<p>{PROSE}</p><!-- never closed <p>{MORE}</p>", PROSE),
        (f"<p>{PROSE}</p><script>never closed <p>{MORE}</p>", PROSE),
    ],
)
def test_pages(page, want):
    assert extract(page) == want


@pytest.mark.parametrize(
    "page",
    ['<a "' * 100_000, '<script "' * 100_000, "<" * 500_000, '<div class="x" ' * 100_000, "<!-- " * 200_000, "<p>" * 100_000, "<div>" * 100_000 + "</x>" * 100_000, "<a '>\">" * 100_000, "</script" * 100_000, "<p a=" * 100_000],
    ids=["quotes", "script", "less", "unclosed", "comments", "p", "ends", "mixed", "script-end", "attributes"],
)
def test_broken_pages_take_linear_time(page):
    begun = time.process_time()
    extract(page)
    assert time.process_time() - begun < 10
