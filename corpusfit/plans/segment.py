"""Split texts into typed sections, inside each text's own row (no shuffle)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusfit.functions import lists
from corpusfit.functions.text import literal_map, sql_text, strip
from corpusfit.scale import spread

Headers = Sequence[tuple[str, Sequence[str]]]


def _lines(c: Column) -> Column:
    return F.split(F.regexp_replace(c, r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n")


def is_header_candidate(s: Column) -> Column:
    """Is a trimmed line short, not a bullet, not a sentence, and title case, upper case or
    ending in a colon? Cheap tests come first."""
    core = F.regexp_replace(s, ":+$", "")
    lower_start = core.rlike(r"(?:^|\s)[\p{L}&&[^\p{Lu}]]")
    upper = (F.upper(core) == core) & core.rlike(r"\p{Lu}")
    return (
        F.length(s).between(2, 60) & ~F.right(s, F.lit(1)).isin(".", "?", "!")
        & ~F.left(s, F.lit(1)).isin(*"-*•◦▪▸►") & s.rlike(r"\p{L}")
        & (s.endswith(":") | ~lower_start | upper)
    )


def nearest_header(word: Column, headers: Headers = lists.SECTION_HEADERS, max_edit: int = 2) -> Column:
    """Struct(distance, place, type) of the closest known heading within ``max_edit``, else null.

    Headings are filed by the word lengths that can be that close, so most words meet none.
    """
    flat = [(h, kind, place) for place, (h, kind) in enumerate((h, kind) for kind, names in headers for h in names)]
    by_length: dict[int, list[str]] = {}
    for h, kind, place in flat:
        for n in range(len(h) - max_edit, len(h) + max_edit + 1):
            by_length.setdefault(n, []).append(
                f"named_struct('header', {sql_text(h)}, 'place', {place}, 'type', {sql_text(kind)})")
    table = F.expr("map(" + ", ".join(f"{n}, array({', '.join(group)})" for n, group in by_length.items()) + ")")
    close = F.transform(
        F.try_element_at(table, F.length(word)),
        lambda h: F.struct(
            F.levenshtein(word, h["header"], max_edit).alias("distance"), h["place"].alias("place"), h["type"].alias("type")))
    return F.array_min(F.filter(close, lambda h: h["distance"] >= 0))


def fuzzy_header_join(terms: DataFrame, headers: Headers = lists.SECTION_HEADERS, max_edit: int = 2) -> DataFrame:
    """Distinct terms that are a known heading with at most ``max_edit`` edits.

    Terms meet only headings of a similar length, by an equi-join on the length; the
    headings are a list the caller holds in memory, so they are broadcast.
    """
    flat = [(h, kind) for kind, names in headers for h in names]
    table = terms.sparkSession.createDataFrame(
        [(len(h) + d, h, kind, place) for place, (h, kind) in enumerate(flat)
         for d in range(-max_edit, max_edit + 1)], "len int, header string, type string, place int")
    met = terms.select("term").distinct().withColumn("len", F.length("term")).join(F.broadcast(table), "len")
    return (
        met.withColumn("distance", F.levenshtein("term", "header", max_edit)).filter("distance >= 0")
        .groupBy("term").agg(F.min(F.struct("distance", "place", "type")).alias("__h"))
        .select("term", F.col("__h.type").alias("section"), F.col("__h.distance").alias("distance")))


def segment(
    docs: DataFrame, headers: Headers = lists.SECTION_HEADERS,
    weights: Mapping[str, float] = lists.SECTION_WEIGHTS, vector_types: DataFrame | None = None,
    id_col: str = "doc_id",
) -> DataFrame:
    """Sections (type, title, start_line, end_line, text, confidence, weight) of each document.

    Headings match exactly (1.0), within two edits (0.85) or, when ``vector_types``
    (line -> type, from a vector classifier) is given, by that table (0.70). A text
    without headings is one "other" section (0.5).
    """
    rows = spread(docs.select(id_col, "text")).withColumn("__lines", _lines(F.coalesce("text", F.lit(""))))
    known = literal_map({h: kind for kind, names in headers for h in names})
    weight_of = literal_map(weights)

    titled = F.filter(
        F.transform("__lines", lambda x, i: F.struct(i.alias("line"), strip(x).alias("title"))),
        lambda h: is_header_candidate(h["title"]))
    worded = F.transform(titled, lambda h: F.struct(
        h["line"].alias("line"), h["title"].alias("title"), F.regexp_replace(F.lower(h["title"]), ":+$", "").alias("word")))
    looked_up = F.transform(worded, lambda h: F.struct(
        h["line"].alias("line"), h["title"].alias("title"), h["word"].alias("word"),
        F.try_element_at(known, h["word"]).alias("exact")))
    typed = F.transform(looked_up, lambda h: F.struct(
        h["line"].alias("line"), h["title"].alias("title"),
        F.coalesce(h["exact"], nearest_header(h["word"], headers)["type"]).alias("type"),
        F.when(h["exact"].isNotNull(), 1.0).otherwise(0.85).alias("confidence")))
    rows = rows.withColumn("__seen", typed)
    if vector_types is not None:
        open_lines = rows.select(
            id_col, F.explode(F.filter("__seen", lambda h: h["type"].isNull())).alias("__h")
        ).select(id_col, F.col("__h.title").alias("line"))
        named = open_lines.distinct().join(vector_types.select("line", "type"), "line").groupBy(id_col).agg(
            F.map_from_entries(F.collect_list(F.struct("line", "type"))).alias("__by_vector"))
        rows = rows.join(named, id_col, "left").withColumn("__seen", F.transform("__seen", lambda h: F.when(
            h["type"].isNull() & F.try_element_at("__by_vector", h["title"]).isNotNull(),
            F.struct(h["line"].alias("line"), h["title"].alias("title"),
                     F.try_element_at("__by_vector", h["title"]).alias("type"), F.lit(0.70).alias("confidence")),
        ).otherwise(h)))
    rows = rows.withColumn("__heads", F.filter("__seen", lambda h: h["type"].isNotNull()))
    last = F.size("__lines") - 1

    def section(h, i):
        end = F.coalesce(F.get("__heads", i + 1)["line"] - 1, last)
        body = F.slice("__lines", h["line"] + 2, F.greatest(end - h["line"], F.lit(0)))
        return F.struct(
            h["type"].alias("type"), h["title"].alias("title"), h["line"].alias("start_line"),
            end.alias("end_line"), strip(F.array_join(body, "\n")).alias("text"),
            h["confidence"].alias("confidence"),
            F.coalesce(F.try_element_at(weight_of, h["type"]), F.lit(0.2)).alias("weight"))

    whole = F.array(F.struct(
        F.lit("other").alias("type"), F.lit("").alias("title"), F.lit(0).alias("start_line"),
        last.alias("end_line"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.5).alias("confidence"),
        F.lit(float(weights.get("other", 0.2))).alias("weight")))
    return rows.select(
        id_col,
        F.explode(F.when(F.size("__heads") > 0, F.transform("__heads", section)).otherwise(whole)).alias("s"),
    ).select(id_col, "s.*")


def section_spans(lines: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Spans from line rows (doc, n, line, header): a header row opens a section that runs to the next.

    The window is one document, which is also the largest unit a text row can hold.
    """
    w = Window.partitionBy(id_col).orderBy("n")
    grouped = lines.withColumn(
        "__section", F.sum(F.col("header").isNotNull().cast("int")).over(w)
    ).filter("__section > 0")
    body = F.array_sort(F.collect_list(F.when(F.col("header").isNull(), F.struct("n", "line"))))
    return grouped.groupBy(id_col, "__section").agg(
        F.max("header").alias("type"), F.min("n").alias("start_line"), F.max("n").alias("end_line"),
        strip(F.array_join(F.transform(body, lambda x: x["line"]), "\n")).alias("text")).drop("__section")


def centroid_classify(vectors: DataFrame, labelled: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Class of the most similar class mean when its cosine is above ``threshold`` (strictly).

    There is one mean per section class, so all means travel together as one value.
    """
    means = (
        labelled.select("label", F.posexplode("embedding").alias("i", "x"))
        .groupBy("label", "i").agg(F.avg("x").alias("x"))
        .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("mean")))
    table = means.agg(F.array_sort(F.collect_list(F.struct("label", "mean")))).scalar()

    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    v = F.col("__v")
    rows = vectors.withColumn("__v", F.transform("embedding", lambda x: x.cast("double"))).withColumn("__m", table)
    scored = F.transform("__m", lambda m: F.struct(
        (dot(v, m["mean"]) / F.nullif(F.sqrt(dot(v, v)) * F.sqrt(dot(m["mean"], m["mean"])), F.lit(0.0))).alias("cosine"),
        (-m["label"]).alias("__order"), m["label"].alias("label")))
    return rows.withColumn("__best", F.array_max(scored)).filter(F.col("__best.cosine") > threshold).select(
        "vec_id", F.col("__best.label").alias("label"), F.col("__best.cosine").alias("cosine"))
