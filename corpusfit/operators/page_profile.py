"""Experience, education and skill entries of profile pages.

A page becomes an array of its tags in order, each with the text after it and the place where its element ends. Elements are
paired with a stack, so nested lists end where they should and an element that is never closed ends with the one around
it. An element's content is then a slice of the array, and all rules are column functions over slices.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from corpusfit.functions.dates import month_text
from corpusfit.functions.text import strip, unescape_common
from corpusfit.operators.sets import dedup_keep_first

# Tags without content, and the marks by which sections and their parts are known.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
WORK_MARKS, WORK_WORDS = ("experience", "workExperience"), ("experience", "work history")
STUDY_MARKS, STUDY_WORDS = ("educationsDetails", "education", "educations"), ("education", "academic")
SKILL_MARKS, SKILL_WORDS = ("skills", "featuredSkills"), ("skills", "expertise")
TITLE, COMPANY = "title|position|role", "company|subtitle|org"
SCHOOL, DEGREE = "school|institution|title|org", "degree|field|subtitle|program"
DATE = "date|duration|time|period"
SKILL, PILL = "skill|name|text", "skill-category|endorsement|pill"

#: Name with its slash, attributes, and the text up to the next tag; a "<" that opens nothing belongs to the text.
TAG = r"(?s)<(/?[A-Za-z][A-Za-z0-9]*)([^>]*+)>((?:[^<]++|<(?![/A-Za-z!]))*+)"


def _element_ends(names: list[str]) -> list[int]:
    ends, stack, opened = [len(names)] * len(names), [], {}
    for at, name in enumerate(names):
        if name in VOID_TAGS:
            ends[at] = at + 1
        elif name[0] != "/":
            stack.append(at)
            opened[name] = opened.get(name, 0) + 1
        elif opened.get(name[1:], 0):  # a closing tag without an open element means nothing
            while True:
                last = stack.pop()
                opened[names[last]] -= 1
                ends[last] = at
                if names[last] == name[1:]:
                    break
    return ends


@F.pandas_udf(ArrayType(IntegerType()))
def element_ends(names: pd.Series) -> pd.Series:
    """For every tag of a page the place of the tag that ends its element; linear in the tags."""
    return names.map(lambda row: None if row is None else _element_ends(list(row)))


def page_tags(html: Column) -> Column:
    """Tags in order as (name, attrs, text); closing tags keep their slash. Scripts, styles and comments are left out."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")
    return F.transform(F.regexp_extract_all(bare, F.lit(TAG), F.lit(0)), lambda t: F.struct(
        F.lower(F.regexp_extract(t, TAG, 1)).alias("name"), F.regexp_extract(t, TAG, 2).alias("attrs"),
        strip(unescape_common(F.regexp_extract(t, TAG, 3))).alias("text")))


def _content(tags: Column, element: Column, base: Column | int = 0) -> Column:
    """Tags inside an element; the array's first tag is the page's tag number ``base``."""
    return F.slice(tags, element["at"] - base + 2, F.greatest(F.lit(0), element["end"] - element["at"] - 1))


def _said(tags: Column, element: Column, base: Column | int = 0) -> Column:
    """All text of an element, its pieces joined."""
    whole = F.slice(tags, element["at"] - base + 1, element["end"] - element["at"])
    return F.array_join(F.transform(whole, lambda t: t["text"]), "")


def _attr_value(tag: Column, name: str) -> Column:
    found = F.regexp_extract(tag["attrs"], rf"""(?is)(?:^|[\s"']){name}\s*=\s*("[^"]*"|'[^']*')""", 1)
    return F.substring(found, F.lit(2), F.greatest(F.lit(0), F.length(found) - 2))


def _classed(tag: Column, names: Sequence[str], words: str) -> Column:
    return tag["name"].isin(*names) & _attr_value(tag, "class").rlike(f"(?i){words}")


def _first(found: Column) -> Column:
    return F.get(found, F.lit(0))


def _section(marks: Sequence[str], words: Sequence[str]) -> Column:
    """The section by its mark, by the words of a heading in it, or any block whose id or class names it."""
    tags = F.col("tags")

    def marked(mark: str) -> Column:
        return _first(F.filter("tags", lambda t: (t["name"] == "section") & (_attr_value(t, "data-section") == mark)))

    def heads(section: Column) -> Column:
        return F.exists(_content(tags, section), lambda h: h["name"].isin("h2", "h3") & F.lower(_said(tags, h)).rlike("|".join(words)))

    def block(attr: str, word: str) -> Column:
        return _first(F.filter("tags", lambda t: t["name"].isin("div", "article") & _attr_value(t, attr).rlike(f"(?i){word}")))

    by_heading = _first(F.filter("tags", lambda t: (t["name"] == "section") & heads(t)))
    return F.coalesce(*[marked(m) for m in marks], by_heading, *[block(attr, word) for word in words for attr in ("id", "class")])


def _entries(items: DataFrame, key: str) -> DataFrame:
    """Entries from list items (``kind, position, tags, base, item``). Each step is a column of its own, so nothing is worked out twice."""
    work, base = F.col("kind") == "experience", F.col("base")

    def one(tag: str, words: str) -> Column:
        """The first part whose class has one of the words, else the first heading."""
        return F.coalesce(
            _first(F.filter("inside", lambda t: _classed(t, (tag, "span"), words))), _first(F.filter("inside", lambda t: t["name"] == tag)))

    def said(part: str) -> Column:
        return F.when(F.col(part).isNotNull(), F.nullif(_said(F.col("tags"), F.col(part), base), F.lit("")))

    parts = items.withColumn("inside", _content(F.col("tags"), F.col("item"), base)).withColumns({
        "named": F.when(work, one("h3", TITLE)).otherwise(one("h3", SCHOOL)),
        "detailed": F.when(work, one("h4", COMPANY)).otherwise(one("h4", DEGREE)),
        "dates": F.transform(F.filter("inside", lambda t: _classed(t, ("span",), DATE)), lambda t: _said(F.col("tags"), t, base))})
    halves = F.split(_first(F.col("dates")), r"\s*[–\-—]\s*")
    # Two dates, or for work also one that is a span.
    both = F.when(F.size("dates") >= 2, F.slice("dates", 1, 2)).when(work & (F.size("dates") == 1) & (F.size(halves) == 2), halves)
    read = parts.select(
        key, "kind", F.col("position").cast("long").alias("position"), said("named").alias("name"), said("detailed").alias("detail"),
        both.alias("both")).select("*", F.get("both", F.lit(0)).alias("start"), F.get("both", F.lit(1)).alias("end"))
    return read.where("name is not null or (kind = 'experience' and detail is not null)").select(
        key, "kind", "position", "name", "detail", month_text(F.col("start")).alias("start_month"), month_text(F.col("end")).alias("end_month"))


def profile_from_page(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``key, kind, position, name, detail, start_month, end_month`` of all list items and skills of a page.

    Skills are the marked parts of their section and then its labels; a page without any has those of the pills anywhere on it.
    A null page has no entries; a repeated page gives its experience and education again and its skills once.
    """
    cut = pages.select(F.col(key), page_tags(F.col("html")).alias("raw"))
    paired = cut.withColumn("ends", element_ends(F.transform("raw", lambda t: t["name"]))).select(key, F.transform(
        "raw", lambda t, i: F.struct(i.alias("at"), F.get(F.col("ends"), i).alias("end"), t["name"].alias("name"),
                                     t["attrs"].alias("attrs"), t["text"].alias("text"))).alias("tags"))
    pills = F.transform(F.filter("tags", lambda t: _classed(t, ("span", "a"), PILL)), lambda t: _said(F.col("tags"), t))
    parts = paired.select(key, "tags", pills.alias("pills"), F.explode(F.array(*[
        F.struct(F.lit(kind).alias("kind"), _section(marks, words).alias("block")) for kind, marks, words in (
            ("experience", WORK_MARKS, WORK_WORDS), ("education", STUDY_MARKS, STUDY_WORDS), ("skill", SKILL_MARKS, SKILL_WORDS))])).alias("part"))
    block = F.col("part.block")
    blocks = parts.select(
        key, F.col("part.kind").alias("kind"), F.coalesce(_content(F.col("tags"), block), F.slice("tags", 1, 0)).alias("tags"),
        (block["at"] + 1).alias("base"), "pills")

    items = blocks.where("kind <> 'skill'").select(
        key, "kind", "tags", "base", F.posexplode(F.filter("tags", lambda t: t["name"] == "li")).alias("position", "item"))
    entries = _entries(items, key)

    marked = F.transform(
        F.filter("tags", lambda t: _classed(t, ("span", "li"), SKILL)), lambda t: _said(F.col("tags"), t, F.col("base")))
    labels = F.transform(
        F.filter("tags", lambda t: t["attrs"].rlike(r"(?i)(?:^|\s)aria-label\s*=")), lambda t: unescape_common(_attr_value(t, "aria-label")))
    found = F.concat(marked, labels)
    skills = blocks.where("kind = 'skill'").select(
        key, F.posexplode(F.when(F.size(found) > 0, found).otherwise(F.col("pills"))).alias("position", "name"))
    skills = dedup_keep_first(
        skills.withColumn("name", strip(F.col("name"))).where(F.length("name").between(1, 99)), [key], "name", "position")
    none = F.lit(None).cast("string")
    return entries.unionByName(skills.select(
        key, F.lit("skill").alias("kind"), F.col("position").cast("long").alias("position"), "name",
        none.alias("detail"), none.alias("start_month"), none.alias("end_month")))
