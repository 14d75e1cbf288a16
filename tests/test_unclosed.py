"""References in pages that end without a semicolon."""

from specforge.sources.pages import page


def test_unclosed_references():
    html = "<h1>Salt &amp; Pepper &amp</h1>"
    assert page(html)["name"] == "Salt & Pepper &"
    assert page(html, closed=True)["name"] == "Salt & Pepper &amp"
    assert page("<h1>a &#38; b &x26; &#x26; c&lt</h1>", closed=True)["name"] == "a & b &x26; & c&lt"
