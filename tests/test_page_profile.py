"""Profile pages: nested and unclosed lists, the ways by which a section is found, labels and pills."""

import time

from corpusfit.operators.page_profile import _element_ends, profile_from_page


def entries(spark, *pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    got = profile_from_page(rows).collect()
    return sorted((r.page_id, r.kind, r.position, r.name, r.detail, r.start_month, r.end_month) for r in got)


def test_nested_lists_and_dates(spark):
    page = """<section data-section="experience"><ul>
      <li><h3 class="x">Lead &amp; <b>maker</b></h3><h4>Firm</h4><ul><li><span class="position">Junior</span></li></ul>
        <span class="date-range">Feb 2001 – Present</span></li>
      <li><h4>Shop</h4><span class="date">1999</span><span class="date">Mar 2000</span></li><li>only text</li></ul></section>
      <li><h3>Outside</h3></li>"""
    # As in the given rules, the outer item takes the first marked tag inside it, also one of the nested list.
    assert entries(spark, page) == [
        (0, "experience", 0, "Junior", "Firm", "2001-02", None), (0, "experience", 1, "Junior", None, None, None),
        (0, "experience", 2, None, "Shop", "1999-01", "2000-03")]


def test_sections_found_by_mark_heading_and_id(spark):
    marked = '<section><h2>Education</h2><li><h3>No</h3></li></section><section data-section="educations"><li><h3>A</h3></li></section>'
    headed = '<div class="education"><li><h3>No</h3></li></div><section><p>x</p><h3>My <i>Academic</i> years</h3><li><h3>B</h3><h4>BSc</h4></li></section>'
    named = '<article id="the-Education-1"><ul><li><h3>C</h3><span class="date">1999 - 2000</span></ul></article><li><h3>Outside</h3></li>'
    assert entries(spark, marked, headed, named) == [
        (0, "education", 0, "A", None, None, None), (1, "education", 0, "B", "BSc", None, None), (2, "education", 0, "C", None, None, None)]


def test_skills_by_part_label_and_pill(spark):
    section = """<section data-section='skills'><span class='skill-name'>Sql</span><li class="skill">SQL</li><button aria-label="C++">x</button>
      <span class="pill-text">Go</span></section><a class="pill">Not read</a>"""
    pills = '<a class="pill">Rust</a><section data-section="skills"><p>none</p></section><span class="skill-category"> Perl </span><a class="pill">' + "x" * 100 + "</a>"
    assert entries(spark, section, pills) == [
        (0, "skill", 0, "Sql", None, None, None), (0, "skill", 2, "Go", None, None, None), (0, "skill", 3, "C++", None, None, None),
        (1, "skill", 0, "Rust", None, None, None), (1, "skill", 1, "Perl", None, None, None)]


def test_odd_pages(spark):
    hidden = '<!-- <section data-section="skills"><span class="skill">No</span></section> --><script>"<a class=\'pill\'>No</a>"</script>'
    assert entries(spark, None, "", "no tags, a < b > c", "</li></section>", "<li", hidden) == []
    open_items = '<section data-section="experience"><ul><li><h3>A < b</h3><li><h3>C</h3></ul></section>'
    assert [(r[2], r[3]) for r in entries(spark, open_items)] == [(0, "A < b"), (1, "C")]
    empty = spark.createDataFrame([], "page_id long, html string, name string, tags string")
    assert profile_from_page(empty).count() == 0
    again = spark.createDataFrame([(1, open_items, "x", "y")] * 2, "page_id long, html string, name string, tags string")
    assert profile_from_page(again).count() == 4


def test_ends_are_linear_and_right():
    assert _element_ends(["ul", "li", "br", "/li", "li", "ul", "/ul", "/ul", "/p", "p"]) == [7, 3, 3, 10, 7, 6, 10, 10, 10, 10]
    began = time.time()
    deep = ["div"] * 200_000 + ["/p", "/div"] * 200_000
    assert _element_ends(deep)[0] == len(deep) - 1 and time.time() - began < 10
