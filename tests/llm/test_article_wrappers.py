"""Articles inside elements whose kind or name usually says otherwise."""

import pytest

from attesta.llm import html_density
from attesta.llm.common import prepared

PROSE = ["The first paragraph tells at some length what happened on the day before the market opened.",
         "A second paragraph, no shorter than the first one, says why it happened and who was there to see it.",
         "The third one closes the account with what was learnt, and what will be done about it next year."]
P = "".join(f"<p>{p}</p>" for p in PROSE)
NAV = "<nav><ul><li><a href='/'>Home</a><li><a href='/x'>More things</a></ul></nav>"
FOOT = "<footer><p>Copyright of the site, all of it, for ever</p></footer>"


@pytest.mark.parametrize("body", [
    f"<form action='/post'>{NAV}<div>{P}</div><input name=x>{FOOT}</form>",
    f"{NAV}<div class='search-content'>{P}</div>{FOOT}",
    f"{NAV}<article class='post sponsored'>{P}</article>{FOOT}",
    f"{NAV}<div class='search-content'>{P}</div><div>Printed on a rainy day</div>{FOOT}",
    f"<div class='sidebar-layout'>{NAV}<main>{P}</main></div>{FOOT}",
    f"{NAV}<div class='comments'>{P}</div>{FOOT}",
    f"{NAV}<article>{P}</article><div class='comments'>{'<p>I do not agree with any of this at all, sorry.</p>' * 30}</div>",
])
def test_the_article_is_found(body):
    assert html_density.main_text(f"<html><head><title>T</title></head><body>{body}</body></html>") == "\n".join(PROSE)


def test_parts_of_an_article_stay():
    page = f"<body>{NAV}<article><header><h2>A title of its own</h2></header>{P}<p>so <math><mi>a</mi><mo>+</mo><mi>b</mi></math> holds</p></article>{FOOT}</body>"
    assert html_density.main_text(page) == "\n".join(["A title of its own", *PROSE, "so a+b holds"])
    assert html_density.main_text("<body><script>x</script></body>") == html_density.main_text(None) == ""
    assert html_density.main_text(f"<body><div hidden>{P}</div><p>Only this is shown.</p></body>") == "Only this is shown."


def test_a_column_of_the_same_name(spark):
    prepared(spark)
    pages = spark.createDataFrame([(1, f"<body>{P}</body>", "x"), (2, None, "y")], "page_id long, html string, extracted string")
    rows = {r["page_id"]: r for r in html_density.extract(pages).collect()}
    assert rows[1]["extracted"] == "x" and rows[1]["extracted_"]["text"] == "\n".join(PROSE) and rows[2]["extracted_"]["n_chars"] == 0
    assert html_density.extract(pages.limit(0)).count() == 0
