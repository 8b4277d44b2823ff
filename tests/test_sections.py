import pytest
from pyspark.sql import functions as F

from citewell import queries
from citewell.operators import sections
from citewell.sources import html

PAGE = """<html><head><style>p{}</style></head><body><nav>Site</nav><main>
<h1>Alpha <span>Fund</span></h1><p>First line of text.</p><script>var x="</p>9.99%";</script>
<h3>Costs</h3><div><div>Expense ratio</div><div>1.04%</div><div>Exit load</div><div>1%</div><div>Rating</div><div>4</div></div>
<div><h2>About</h2></div><p>Long prose here<br>and more.<p>Unclosed too
<h2>Home</h2><p>still about</p>
<div class="footer_ab12__x9">Copyright</div><h4>Table</h4><table><tr><td>One<td>Two</table></main></body></html>"""


def test_sections_in_document_order():
    mode, error, found = html.extract(PAGE, 10)
    assert (mode, error) == (html.HEADING_WALK, None)
    assert [s["section_title"] for s in found] == ["Alpha Fund", "Costs", "About", "Table"]
    assert "9.99" not in " ".join(s["text"] for s in found)
    assert "Copyright" not in " ".join(s["text"] for s in found)
    assert found[1]["text"].split("\n") == ["Expense ratio", "1.04%", "Exit load", "1%", "Rating", "4"]
    assert found[2]["text"].split("\n") == ["Long prose here and more.", "Unclosed too", "Home", "still about"]
    assert found[3]["in_table"] and found[3]["text"] == "One\nTwo"


def test_short_page_is_an_error_not_an_exception():
    assert html.extract("<p>x</p>", 500)[:2] == (None, "extraction gave 0 characters by headings and 1 in all, under 500")
    assert html.extract(None, 1)[2] == []


def test_page_without_headings_falls_back():
    mode, _, found = html.extract("<body><p>" + "word " * 50 + "</p></body>", 100)
    assert mode == html.ALL_TEXT and found[0]["section_title"] == html.UNTITLED_PAGE


def test_deep_nesting_does_not_recurse():
    assert html.extract("<div>" * 5000 + "x" * 600, 500)[0] == html.ALL_TEXT


@pytest.mark.parametrize(
    "given, pairs",
    [
        ("Rating\n4\nLoad: 1%\nMin 500", 3),
        ("Just prose that goes on\nand on.", 0),
        ("Label\n\n5", 0),
        ("A label\nAnother\n5%", 1),
    ],
)
def test_count_pairs(value, given, pairs):
    from citewell.functions.text import split_lines

    assert value(sections.count_pairs(split_lines(F.lit(given)))) == pairs


def test_extract_pages_and_udtf(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string")
    from citewell.config import Settings

    rows = {r.page_id: r for r in html.extract_pages(pages, "html", Settings(min_page_chars=10)).collect()}
    assert [s.section_title for s in rows[1].sections] == ["Alpha Fund", "Costs", "About", "Table"]
    assert [s.is_table for s in rows[1].sections] == [False, True, False, True]
    assert rows[2].error and rows[3].error and not rows[2].sections
    html.register(spark)
    pages.createOrReplaceTempView("some_pages")
    n = spark.sql("SELECT count(*) FROM some_pages, LATERAL sectionize(html)").first()[0]
    assert n == 0  # under the default floor of characters


def test_repair_is_idempotent_and_rehashes(spark):
    once = sections.build_documents(queries.repair_input(spark), F.lit("2026-01-31"))
    twice = sections.repair_figures(once)
    key = lambda df: sorted((r.scheme_id, r.content_sha256, [s.text for s in r.sections]) for r in df.collect())
    assert key(once) == key(twice)
    prose = {r.scheme_id: r.sections[2].text for r in once.collect()}
    assert prose == {r[0]: r[4] for r in queries.REPAIRS}


def test_build_documents_drops_empty_and_renumbers(spark):
    df = spark.sql(
        "SELECT 'a' scheme_id, 'n' scheme_name, 'c' category, 'p' plan, 'u' final_url, 'm' extraction_mode, "
        "from_json('[{\"section_title\":\" \",\"heading_level\":2,\"text\":\" x  y \",\"is_table\":false,\"order\":5},"
        "{\"section_title\":\"t\",\"heading_level\":2,\"text\":\" \",\"is_table\":false,\"order\":6},"
        "{\"section_title\":\"t2\",\"heading_level\":2,\"text\":\"z\",\"is_table\":true,\"order\":7}]', "
        "'array<struct<section_title:string,heading_level:int,text:string,is_table:boolean,order:int>>') sections"
    )
    (row,) = sections.build_documents(df, F.lit("2026-01-31")).collect()
    assert [(s.section_title, s.text, s.order) for s in row.sections] == [("Untitled", "x y", 0), ("t2", "z", 1)]


def test_references_without_a_semicolon_are_text(spark):
    page = "<article><h1>A &amp; B&amp</h1><p>" + "word " * 200 + "&lt;x&gt; &ampx; &copy</p></article>"
    df = spark.createDataFrame([(1, page)], "page_id int, html string")
    one = html.extract_pages(df, whole=True).first().sections[0]
    assert one.section_title == "A & B&amp" and one.text.endswith("word <x> &ampx; &copy")
    assert html.extract_pages(df).first().sections[0].section_title == "A & B&"
