"""Lines beside a page's article."""

from quelora.llm import html


def test_differencing_decides_beside_an_article():
    frame = "<body><div>Site name</div><div><p>{}</p></div><article><p>quote</p><p>teaser {}</p></article><div>Read on</div></body>"
    one, two, three = (html.Page((k, None), "h", f"a/{k}", frame.format(f"body {k}", k)) for k in range(3))
    assert two.text([one, three]) == ("body 1\nquote\nteaser 1", 3, 2, 0)
    assert two.text([]) == ("Site name\nbody 1\nquote\nteaser 1\nRead on", 0, 0, 0)
