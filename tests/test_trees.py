"""Markup whose tags don't pair up, and what expressions and trees must agree on."""

import time

import pytest
from pyspark.sql import functions as F

from postworks.functions import markup, text, tree

DESCRIPTIONS = {
    "<p>Hello<br/>World</p>": "Hello\nWorld",
    "Hello <b>bold</b> world": "Hello\nbold\nworld",
    "<p>One</p><ul><li>a <i>b</i> c</li><li> d</li></ul>tail": "One\na b c\nd\ntail",
    "<script>no</script>a<style>x</style>b<!-- c -->d": "a\nb\nd",
    "a &amp; b &lt;c&gt;&nbsp; d ": "a & b <c>  d",
    "plain  text\nwith \t lines": "plain text\nwith lines",
    "x\n\n\n\ny": "x\n\ny",
    "1 < 2 <b>so</b>": "1 < 2\nso",
    "&copy; 2024&nbsp;&middot; it&rsquo;s": "© 2024 · it’s",
    "<ul><li></li><li> </li></ul>": "",
    "": "",
}
ODD = {
    "<ul><li>a<li>b <b>c</b></ul>d": "a\nb c\nd",
    "<ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul>": "a b c\nd",
    "<p>one<p>two &rsquo;q&#8217;&eacute;": "one\ntwo ’q’é",
    "<li>x": "x",
}


def test_descriptions(spark):
    cases = list((DESCRIPTIONS | ODD).items())
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)] + [(len(cases), None)], "i int, h string")
    found = [r.t for r in rows.select("i", text.description_text(F.col("h")).alias("t")).orderBy("i").collect()]
    assert found == [t for _, t in cases] + [""]
    assert [tree._lines(h) for h, _ in cases] == [t for _, t in cases]


def test_names_without_a_semicolon_are_text(spark):
    cases = {"<p>ver&amp</p>b": "ver&amp\nb", "a&copy b &amp; &notit; &eacute;": "a&copy b & &notit; é", "<li>x &amp y<li>&amp": "x &amp y\n&amp"}
    rows = spark.createDataFrame(list(cases.items()), "h string, want string")
    assert [r for r in rows.select("want", text.description_text(F.col("h")).alias("t")).collect() if r.t != r.want] == []


BOLD = [
    "<h1>T</h1><b>Location:</b> USA AL<br>Huntsville<b>Level</b> 3",
    "<div class='career-detail-description'><b>Duties:</b><ul><li>one <i>x</i></li><li>two</li></ul>after<b>End</b></div><b>Menu</b> no",
    "<p><b>A</b> short</p><p><b>A:</b> much longer</p><div><b>B</b><p>in p</p><span>s</span></div>",
    "no labels", "<b></b>x", "",
]


def test_labels_by_tree_are_those_by_expressions(spark):
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(BOLD)], "i int, h string")
    found = rows.select("i", tree.pairs_up(F.col("h")).alias("pairs"), markup.bold_blocks(F.col("h")).alias("b"), tree.label_map(F.col("h")).alias("t")).orderBy("i").collect()
    for r in found:
        assert r.pairs and r.b == r.t, BOLD[r.i]
    assert found[0].b == {"Location": "USA AL Huntsville", "Level": "3", "Page Title": "T"}
    assert found[1].b == {"Duties": "one x\ntwo", "End": ""}


@pytest.mark.parametrize(("html", "labels"), [
    ("<p><b>A:</b> one<p><b>B</b> two", {"A": "one", "B": "two"}),
    ("<b>Skills</b><ul><li>x<li>y</ul><b>More</b>z", {"Skills": "x\ny", "More": "z"}),
    ("<b>Nested</b><ul><li>a<ul><li>b</ul></ul>", {"Nested": "a b\nb"}),
    ("<b><p>Odd:</b> value", {"Odd": "value"}),
])
def test_labels_of_unpaired_tags(spark, html, labels):
    row = spark.createDataFrame([(html,)], "h string").select(tree.pairs_up(F.col("h")).alias("pairs"), markup.bold_blocks(F.col("h")).alias("b")).first()
    assert not row.pairs and row.b == labels


def test_many_labels(spark):
    page = "".join(f"<b>Label {i}:</b> value {i}<br>" for i in range(10_000))
    rows = spark.createDataFrame([(page,)], "h string")
    began = time.time()
    found = rows.select(markup.bold_blocks(F.col("h")).alias("b")).first().b
    assert len(found) == 10_000 and found["Label 9999"] == "value 9999" and time.time() - began < 20
