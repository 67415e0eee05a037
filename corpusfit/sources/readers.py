"""Reading documents, import files and JSON lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusfit.functions.text import strip
from corpusfit.scale import cut_lineage, ordered_rank

MAX_MB = 20
# Accepted extensions and the first bytes their files must have (hex).
MAGIC = {"pdf": ("25504446",), "docx": ("504B0304",), "doc": ("D0CF11E0", "504B0304")}
IMPORT_FIELDS = ("phone", "linkedin_url", "github_url", "portfolio_url", "current_title", "experience_level")


def scan_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with text; column choice and the null test reach the Parquet scan."""
    return spark.read.parquet(f"{folder}/documents.parquet").filter(F.col("text").isNotNull())


def json_list_safe(c: Column, element_type: str = "string") -> Column:
    """Array from a JSON list; anything else gives an empty array."""
    parsed = F.when(F.ltrim(c).startswith("["), F.from_json(c, f"array<{element_type}>"))
    return F.coalesce(parsed, F.array().cast(f"array<{element_type}>"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)


def file_triage(files: DataFrame, max_mb: int = MAX_MB) -> DataFrame:
    """Accept files (path, length, content) by extension, size and first bytes; say why not."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    head = F.hex(F.substring("content", 1, 4))
    fits = F.lit(False)
    for name, starts in MAGIC.items():
        fits = fits | ((ext == name) & head.isin(*starts))
    reason = (
        F.when(~ext.isin(*MAGIC), "unsupported extension")
        .when(F.col("length") > max_mb * 1024 * 1024, "too large")
        .when(F.col("length") == 0, "empty file")
        .when(~fits, "content does not match extension"))
    return files.select("path", reason.isNull().alias("ok"), reason.alias("reason"))


#: A record of more lines than this is taken for one whose quote is never closed.
MOST_LINES = 1000


def csv_records(spark: SparkSession, path: str, most_lines: int = MOST_LINES) -> DataFrame:
    """Records of CSV files with the file, the line on which they begin, their number of lines, and their text.

    A quoted field may hold line ends, and files are still read in splits: lines and quotes are counted within each split,
    the sums of the splits before it are added, and a line belongs to the record that is open where it begins. Only
    records of several lines are gathered. A quote opens or closes a field wherever it stands, so quotes inside a value have
    to be doubled and the value quoted. Blank lines between records are left out. A record of more than
    ``most_lines`` lines has no text (null): only that many lines are ever held together.
    """
    c = F.col
    lines = spark.read.text(path).select(
        c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("__at"), c("value").alias("line"),
        F.regexp_count("value", F.lit('"')).alias("quotes"))
    upto = Window.partitionBy("file", "split").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = lines.withColumn("__n", F.count(F.lit(1)).over(upto)).withColumn("__q", F.sum("quotes").over(upto))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    # A few numbers per split. The last line that begins a record is kept for each parity that the split may start with.
    even, odd = (c("__q") - c("quotes")) % 2 == 0, (c("__q") - c("quotes")) % 2 == 1
    sums = placed.groupBy("file", "split").agg(
        F.count(F.lit(1)).alias("__lines"), F.sum("quotes").alias("__quotes"),
        F.max(F.when(even, c("__n"))).alias("__even"), F.max(F.when(odd, c("__n"))).alias("__odd")
    ).withColumn("__n0", F.coalesce(F.sum("__lines").over(earlier), F.lit(0))).withColumn(
        "__q0", F.coalesce(F.sum("__quotes").over(earlier), F.lit(0)))
    own = c("__n0") + F.when(c("__q0") % 2 == 0, c("__even")).otherwise(c("__odd"))
    splits = sums.withColumn("__open", F.last(own, True).over(earlier)).select("file", "split", "__n0", "__q0", "__open")
    begins = (c("__q0") + c("__q") - c("quotes")) % 2 == 0
    numbered = placed.join(splits, ["file", "split"]).withColumn("line_no", c("__n0") + c("__n")).withColumn(
        "begins", begins).withColumn("ends", (c("__q0") + c("__q")) % 2 == 0).withColumn(
        "record", F.coalesce(F.last(F.when(c("begins"), c("line_no")), True).over(upto), c("__open")))
    single = numbered.where(c("begins") & c("ends") & (F.trim("line") != "")).select(
        "file", c("line_no").alias("row_no"), F.lit(1).cast("long").alias("lines"), c("line").alias("record"))
    held = F.when(c("line_no") - c("record") < most_lines, F.struct("line_no", "line"))
    several = numbered.where(~(c("begins") & c("ends"))).groupBy("file", c("record").alias("row_no")).agg(
        F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_list(held)).alias("__l"), F.max(c("ends") & ~c("begins")).alias("__closed"))
    whole = F.when(c("__closed") & (c("lines") <= most_lines), F.array_join(F.transform("__l", lambda x: x["line"]), "\n"))
    return single.unionByName(several.select("file", "row_no", "lines", whole.alias("record")))


def read_import_csv(spark: SparkSession, path: str, most_lines: int = MOST_LINES) -> tuple[DataFrame, DataFrame]:
    """(rows, bad records) of CSV files with a header each.

    Rows have the file, ``row_no`` (the line on which the record begins; the header is line 1) and the trimmed values under
    the trimmed lower-case headers of all files; a column that a file lacks, or a value that a short record lacks, is empty.
    Bad records (file, row_no, lines, reason) have more values than the header or a quote that is never closed.
    A header given twice counts at its first place. Files without a line give nothing. One number and the
    headers of the files that differ are read by the driver.
    """
    c = F.col
    records = cut_lineage(csv_records(spark, path, most_lines))
    first = records.groupBy("file").agg(F.min_by(F.struct("row_no", "record"), "row_no").alias("__first"))

    def values(text, width):
        return F.from_csv(
            text, ", ".join(f"c{k} string" for k in range(width)), {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})

    # More values than commas plus one there cannot be.
    width = 2 + (first.agg(F.max(F.regexp_count("__first.record", F.lit(",")))).first()[0] or 0)
    names = [f"c{k}" for k in range(width)]
    cells = records.withColumn("__c", values(c("record"), width))
    heads = cells.join(first.select("file", c("__first.row_no").alias("row_no")), ["file", "row_no"]).select(
        "file", c("row_no").alias("__head"), F.transform(F.filter(F.array(*[c(f"__c.{n}") for n in names]), lambda x: x.isNotNull()),
                                  lambda x: F.lower(strip(F.replace(x, F.lit("\ufeff"), F.lit(""))))).alias("__names"))
    known = sorted({n for row in heads.select("__names").distinct().toLocalIterator() for n in row[0] if n})
    rows = cells.join(heads, "file").where(c("row_no") > c("__head")).withColumn(
        "__v", F.array(*[F.coalesce(strip(c(f"__c.{n}")), F.lit("")) for n in names])).withColumn(
        "__reason", F.when(c("record").isNull(), "quote is not closed").when(
            F.exists(F.slice("__v", F.size("__names") + 1, width), lambda x: x != ""), "more values than headers"))

    def of(name):
        at = F.array_position("__names", name)
        return F.when(at > 0, F.get("__v", (at - 1).cast("int"))).otherwise("").alias(name)

    good = rows.where("__reason is null").select("file", "row_no", *[of(n) for n in known if n not in ("file", "row_no")])
    return good, rows.where("__reason is not null").select("file", "row_no", "lines", c("__reason").alias("reason"))


def number_rows(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Row numbers as in a sheet: the header is row 1."""
    return ordered_rank(rows, order, "__n").withColumn("row_no", F.col("__n") + 1).drop("__n")


def bulk_import(rows: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Merge import rows (row_no, name, email, optional fields) into people.

    Returns (people after the import with ``action`` created/updated/kept, rejected rows).
    Rows are matched on the lower-cased address; a placeholder name and empty optional
    fields are filled from the first row that has a value, nothing else is overwritten.
    Rows without an address each make a new person (``candidate_id`` null, numbered later).
    """
    for name in ("name", "email", *IMPORT_FIELDS):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(""))
    empty = (F.coalesce("name", F.lit("")) == "") & (F.coalesce("email", F.lit("")) == "")
    errors = rows.filter(empty).select("row_no", F.lit("row without name and address").alias("reason"))
    good = rows.filter(~empty).withColumn("__key", F.nullif(F.lower("email"), F.lit("")))
    fields = [f for f in IMPORT_FIELDS if f in candidates.columns]

    def first(c):
        value = F.nullif(F.col(c), F.lit(""))
        return F.min_by(value, F.when(value.isNotNull(), F.col("row_no"))).alias(f"__{c}")

    keyed = good.filter(F.col("__key").isNotNull()).groupBy("__key").agg(*[first(c) for c in ("name", *fields)])
    loose = good.filter(F.col("__key").isNull()).select(
        F.lit(None).cast("string").alias("__key"),
        *[F.nullif(F.col(c), F.lit("")).alias(f"__{c}") for c in ("name", *fields)])
    incoming = keyed.unionByName(loose).withColumn("__in", F.lit(True))
    known = candidates.withColumn("__key", F.lower("email"))
    both = known.join(incoming, "__key", "full")
    is_new = F.col("candidate_id").isNull()
    made_name = F.coalesce(F.col("__name"), F.initcap(F.replace(F.element_at(F.split("__key", "@"), 1), F.lit("."), F.lit(" "))))

    def merged(c):
        new = F.lower(f"__{c}") if c == "experience_level" else F.col(f"__{c}")
        return F.coalesce(F.nullif(F.col(c), F.lit("")), new).alias(c)

    after = both.select(
        "candidate_id",
        F.when(is_new, made_name)
        .when(F.col("name").isin("", "Unknown"), F.coalesce("__name", "name")).otherwise(F.col("name")).alias("name"),
        F.coalesce("email", "__key").alias("email"), *[merged(c) for c in fields],
        F.when(is_new, "created").when(F.col("__in"), "updated").otherwise("kept").alias("action"))
    return after, errors
