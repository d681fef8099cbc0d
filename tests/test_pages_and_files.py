"""Lines of pages, and detail pages in large numbers."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from facetgrid import details
from facetgrid.operators.page_tree import PageLines

# --- page lines ---


def lines_of(html):
    return [t for _, t in PageLines().eval(html)]


def test_lines_decode_what_the_sql_decodes():
    assert lines_of("<p>and&ampTo &lt x&lt;y &amp;lt; &eacute; &#65;</p>") == ["and&ampTo &lt x<y &lt; &eacute; &#65;"]
    assert lines_of("<p>a&am<b>p;</b>c&nbsp; d\r\n e</p>") == ["a&c d", "e"]
    assert lines_of("<p>x　y</p><script>a&amp;b</script><p>\U0010ffff&amp;&quot;</p>") == ["x　y", "\U0010ffff&\""]
    assert lines_of(None) == [] and lines_of("<p> \t</p>") == []


# --- detail pages ---


def test_runs_of_bare_tags_give_the_tree_of_the_tokenizer():
    from facetgrid.operators.html_detail import Tree

    class Plain(Tree):
        parse_starttag, parse_endtag = HTMLParser.parse_starttag, HTMLParser.parse_endtag

    def tree(kind, html):
        t = kind()
        t.feed(html)
        t.close()
        shown = lambda n: n if isinstance(n, str) else (n.name, n.classes, [shown(c) for c in n.children])
        return shown(t.root)

    rng = random.Random(4)
    bits = ["<p>", "<td>", "<th>", "<table>", "<tr>", "</td>", "</table>", "<br>", "<br/>", "<script>", "</script>", "<title>", "</title>", "<textarea>", "<div class=a>", "<DIV>", "</Div>", "<", "<!-- -->", "&", "&amp;", "&lt", "x", "<a href='x>y'>", "</", ">", " ", "\n"]
    for _ in range(3000):
        html = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        assert tree(Tree, html) == tree(Plain, html), html


def test_pages_of_few_rows_are_read_by_all_tasks(spark):
    pages = details.detail_pages(spark, "/root/testdata/sf0.001")
    parts = {r[0] for r in pages.select(F.spark_partition_id()).distinct().collect()}
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))
