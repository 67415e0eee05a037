"""Text rules as Column expressions; they run inside the JVM and need no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusfit.functions import lists

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def sql_text(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_array(values: Sequence[str]) -> Column:
    """Array of constants; parsed from one expression, since a call per element is slow to build."""
    return F.expr("array(" + ", ".join(sql_text(v) for v in values) + ")")


def literal_map(pairs: dict[str, str | float]) -> Column:
    items = ", ".join(
        f"{sql_text(k)}, {sql_text(v) if isinstance(v, str) else repr(float(v)) + 'D'}" for k, v in pairs.items())
    return F.expr(f"map({items})")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it: a lambda's parts are not shared by the planner."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def text_lines(c: Column) -> Column:
    return F.split(c, r"\r\n|\r|\n")


def trimmed_lines(c: Column) -> Column:
    return F.filter(F.transform(text_lines(c), strip), lambda x: x != "")


# -- normal forms ---------------------------------------------------------------------------------

def norm_fingerprint(c: Column) -> Column:
    """Lower case without ASCII punctuation, single spaces."""
    return squeeze(F.translate(F.lower(c), PUNCTUATION, ""))


def norm_tech(c: Column) -> Column:
    """Lower case; word characters, spaces and + # - . stay."""
    return squeeze(F.regexp_replace(F.lower(c), r"(?U)[^\w\s+#.\-]", " "))


def title_case(c: Column) -> Column:
    return F.initcap(F.lower(c))


def name_from_email(email: Column) -> Column:
    local = F.element_at(F.split(email, "@"), 1)
    return title_case(F.regexp_replace(local, r"[._\-]", " "))


def salvage_name(email: Column, file_name: Column, blocked: Sequence[str] = lists.NOT_NAME_WORDS) -> Column:
    """Best guess at a name from an address, then from a file name, else a placeholder."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    first = F.regexp_replace(strip(F.element_at(F.split(stem, "_"), 1)), "-", " ")
    first = strip(F.regexp_replace(strip(first), r"\s+\d+$", ""))
    first = strip(F.regexp_replace(first, r"(?i)\s+(resume|cv|updated|new|final|copy)\s*$", ""))
    return F.coalesce(
        F.when(email != "", name_from_email(email)),
        F.when((first != "") & plausible_name(first, blocked), title_case(first)),
        F.lit("Unknown Candidate"),
    )


# -- contacts and links ---------------------------------------------------------------------------

def extract_email(c: Column) -> Column:
    """First address in the whole text, lower-cased."""
    return F.lower(first_match(c, lists.EMAIL_PATTERN))


def extract_phone(c: Column) -> Column:
    """First phone-like run with 7 to 15 digits in the whole text."""
    usable = F.filter(
        all_matches(c, lists.PHONE_PATTERN),
        lambda p: F.length(F.regexp_replace(p, r"\D", "")).between(7, 15))
    return strip(F.get(usable, F.lit(0)))


def extract_links(c: Column) -> Column:
    return F.struct(
        first_match(c, lists.PROFILE_URL_PATTERN).alias("profile_url"),
        first_match(c, lists.CODE_URL_PATTERN).alias("code_url"),
        first_match(c, lists.OTHER_URL_PATTERN).alias("other_url"),
    )


def job_ref(subject: Column) -> Column:
    return first_match(subject, lists.JOB_REF_PATTERN, 1).try_cast("int")


def url_username(url: Column) -> Column:
    """Owner part of a code-host URL, or a bare valid user name."""
    url = strip(url)
    from_url = first_match(F.regexp_replace(url, r"[?#].*$", ""), r"^https?://[^/]*/+([^/]+)", 1)
    bare = first_match(url, r"^[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,37}[a-zA-Z0-9])?$")
    return F.when(url.startswith("http"), from_url).otherwise(bare)


def canonical_profile_url(url: Column) -> Column:
    url = strip(url)
    full = F.when(url.startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.regexp_extract(full, r"^[a-z]+://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(full, r"^[a-z]+://[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")
    return F.when(
        host.contains("linkedin.com") & path.startswith("in/"),
        F.concat(F.lit("https://www.linkedin.com/"), path))


# -- names and titles -----------------------------------------------------------------------------

def _is_name_word(word: Column, blocked: Column) -> Column:
    bare = F.regexp_replace(word, r"\.+$", "")
    return (
        F.when(F.length(bare) == 1, bare.rlike("^[A-Z]$"))
        .when(bare.rlike("^[A-Z]+$"), ~F.array_contains(blocked, F.lower(bare)))
        .otherwise(bare.rlike(r"^[A-Z][a-z\-]+$"))
    )


def _name_of_line(line: Column, blocked_words: Sequence[str]) -> Column:
    """Name held by one header line, or null."""
    blocked, headings = literal_array(blocked_words), literal_array(lists.HEADING_PHRASES)
    refused = line.rlike(r"\d") | F.lower(line).rlike(r"@|\\|http|linkedin|github|www\.")
    value = strip(F.regexp_extract(line, r"^[A-Za-z\s]{1,20}:\s*(.+)$", 1))
    labelled = line.rlike(r"^[A-Za-z\s]{1,20}:\s*.+$")
    body = F.when(labelled, F.when(~value.contains(":"), value)).otherwise(line)
    clean = F.regexp_replace(strip(F.regexp_replace(body, r"[^a-zA-Z\s.\-]", "")), r"^\.+|\.+$", "")
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"\.+$", ""))
    sized = F.size(words).between(2, 6)
    free = ~F.array_contains(headings, F.regexp_replace(F.lower(clean), r"\.+$", "")) & ~F.arrays_overlap(
        plain, blocked)
    comma = r"^([A-Z][A-Za-z\-]+),\s+([A-Z][A-Za-z\-]+(?:\s+[A-Z][A-Za-z\-]+)?)$"
    turned = F.concat(F.regexp_extract(body, comma, 2), F.lit(" "), F.regexp_extract(body, comma, 1))
    tidy = F.array_join(
        F.transform(words, lambda w: F.when(
            F.regexp_replace(w, r"\.+$", "").rlike("^[A-Z]{2,}$"), title_case(w)).otherwise(w)), " ")
    real = F.exists(words, lambda w: F.length(F.regexp_replace(w, r"\.+$", "")) > 1)
    letters = F.regexp_replace(clean, r"[^a-zA-Z\s]", "")
    letter_words = F.filter(F.split(letters, r"\s+"), lambda w: w != "")
    shouted = F.size(letter_words).between(2, 5) & letters.rlike(r"^[A-Z\s]+$") & letters.rlike("[A-Z]")
    return F.when(
        ~refused & body.isNotNull() & sized & free,
        F.when(body.rlike(comma) & ~F.array_contains(headings, F.lower(turned)), turned)
        .when(F.forall(words, lambda w: _is_name_word(w, blocked)) & real, tidy)
        .when(shouted & ~F.arrays_overlap(F.transform(letter_words, F.lower), blocked),
              title_case(strip(letters))))


def extract_name(c: Column, blocked: Sequence[str] = lists.NOT_NAME_WORDS, header_lines: int | None = 6) -> Column:
    """First name found in the non-empty header lines; of a piped line only the first part counts.

    ``header_lines`` is how many lines count as the header; with None all lines do.
    """
    head = trimmed_lines(c) if header_lines is None else F.slice(trimmed_lines(c), 1, header_lines)
    first_part = F.transform(head, lambda x: strip(F.element_at(F.split(x, r"\|"), 1)))
    names = F.transform(first_part, lambda x: _name_of_line(x, blocked))
    return F.get(F.filter(names, lambda n: n.isNotNull()), F.lit(0))


def plausible_name(name: Column, blocked: Sequence[str] = lists.NOT_NAME_WORDS) -> Column:
    """No blocked word and at least one word shaped like a name."""
    bad = literal_array(blocked)
    clean = F.lower(strip(F.regexp_replace(name, r"[^a-zA-Z\s]", "")))
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    return F.coalesce(
        (F.size(words) > 0) & ~F.arrays_overlap(words, bad)
        & F.exists(words, lambda w: _is_name_word(title_case(w), bad)),
        F.lit(False))


def extract_title(experience: Column) -> Column:
    """First usable line with a title word or of two to seven words."""
    titles = literal_array(lists.TITLE_WORDS)
    usable = F.filter(
        trimmed_lines(experience),
        lambda x: (F.length(x).between(4, 120)) & ~x.rlike(r"^[\d\s\-/,–—|•]+$")
        & (F.arrays_overlap(F.split(F.lower(x), r"\s+"), titles)
           | F.size(F.split(x, r"\s+")).between(2, 7)))
    return F.get(usable, F.lit(0))


# -- years ----------------------------------------------------------------------------------------

def _year_of(token: Column, as_of_year: int) -> Column:
    return F.coalesce(
        F.nullif(F.regexp_extract(token, r"\d{4}", 0), F.lit("")).cast("int"), F.lit(as_of_year))


def year_ranges(c: Column, as_of_year: int) -> Column:
    """Valid (start_year, end_year) spans in text order, with ``intern`` set when an internship
    word stands in the last five non-empty lines before the span."""
    pattern = lists.YEAR_RANGE_PATTERN
    pieces = F.split(c, pattern, -1)
    parts = F.arrays_zip(
        pieces.alias("before"), all_matches(c, pattern).alias("whole"),
        all_matches(c, pattern, 1).alias("first"), all_matches(c, pattern, 2).alias("last"))
    empty = F.expr(
        "named_struct('tail', '', 'found', "
        "cast(array() as array<struct<start_year:int,end_year:int,intern:boolean>>))")

    def last_five(lines):
        return bound(lines, lambda x: F.slice(x, F.greatest(F.size(x) - 4, F.lit(1)), 5))

    def filled(lines):
        return F.filter(lines, lambda x: x.rlike(r"(?U)\S"))

    def step(acc, part):
        # The last line is still open: the span and what follows it belong to it.
        return bound(F.split(F.concat(acc["tail"], part["before"]), "\n"), lambda lines: bound(
            last_five(filled(F.slice(lines, 1, F.size(lines) - 1))), lambda closed: add(acc, part, F.element_at(lines, -1), closed)))

    def add(acc, part, open_line, closed):
        near = last_five(filled(F.array_append(closed, open_line)))
        span = F.struct(
            _year_of(part["first"], as_of_year).alias("start_year"),
            _year_of(part["last"], as_of_year).alias("end_year"),
            F.array_join(near, "\n").rlike(lists.INTERN_PATTERN).alias("intern"))
        return F.struct(
            F.array_join(F.array_append(closed, F.concat(open_line, part["whole"])), "\n").alias("tail"),
            F.array_append(acc["found"], span).alias("found"))

    matched = F.filter(parts, lambda p: p["whole"].isNotNull())
    spans = F.aggregate(matched, empty, step, lambda acc: acc["found"])
    return F.filter(
        spans, lambda s: s["start_year"].between(1970, as_of_year)
        & s["end_year"].between(s["start_year"], F.lit(as_of_year + 1)))


def merged_years(spans: Column) -> Column:
    """Years covered by the union of (start_year, end_year) structs; touching spans merge."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("int").alias("reach"))

    def step(acc, span):
        reach = F.greatest(acc["reach"], span["end_year"])
        fresh = acc["reach"].isNull() | (span["start_year"] > acc["reach"])
        gain = F.when(fresh, span["end_year"] - span["start_year"]).otherwise(reach - acc["reach"])
        return F.struct((acc["total"] + gain).cast("long").alias("total"), reach.cast("int").alias("reach"))

    return F.aggregate(F.array_sort(spans), start, step)["total"].cast("double")


def years_phrase(c: Column) -> Column:
    """First "N+ years" figure between 0 and 50."""
    both = F.zip_with(
        all_matches(c, lists.YEARS_PATTERN, 1), all_matches(c, lists.YEARS_PATTERN, 2),
        lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b).try_cast("double"))
    return F.get(F.filter(both, lambda y: (y > 0) & (y < 50)), F.lit(0))


def years_of_experience(experience: Column, summary: Column, as_of_year: int) -> Column:
    """Union of spans outside internships, else a figure stated in the summary."""
    outside = F.filter(year_ranges(experience, as_of_year), lambda s: ~s["intern"])
    bare = F.transform(outside, lambda s: F.struct(s["start_year"], s["end_year"]))
    return bound(bare, lambda spans: F.when(F.size(spans) > 0, merged_years(spans)).otherwise(years_phrase(summary)))


def graduation_candidates(c: Column, as_of_year: int) -> Column:
    """All years that could be a graduation year, by five readings of the text."""
    return bound(c, lambda text: _graduation_candidates(text, as_of_year))


def _graduation_candidates(c: Column, as_of_year: int) -> Column:
    def ints(array):
        return F.transform(array, lambda y: F.nullif(y, F.lit("")).try_cast("int"))

    short = F.zip_with(
        all_matches(c, lists.SHORT_SPAN_PATTERN, 1), all_matches(c, lists.SHORT_SPAN_PATTERN, 2),
        lambda s, e: F.struct(s.cast("int").alias("s"),
                              (F.floor(s.cast("int") / 100) * 100 + e.cast("int")).cast("int").alias("e")))
    expanded = F.transform(short, lambda p: F.when(p["e"] < p["s"], p["e"] + 100).otherwise(p["e"]))
    range_ends = F.transform(
        all_matches(c, lists.YEAR_RANGE_PATTERN, 2), lambda t: F.regexp_extract(t, r"\d{4}", 0))
    found = F.concat(
        ints(all_matches(c, lists.GRADUATION_PATTERN, 1)), ints(all_matches(c, lists.GRADUATION_PATTERN, 2)),
        ints(all_matches(c, lists.FULL_SPAN_PATTERN, 2)), ints(range_ends), expanded,
        ints(all_matches(c, lists.BARE_YEAR_PATTERN, 1)))
    return F.filter(found, lambda y: y.between(1980, as_of_year + 2))


SEPARATOR = "\n|\n"


def degree_lines(c: Column, ahead: int = 5) -> Column:
    """Lines with a degree word and up to ``ahead`` lines after each, until another heading."""
    stops = literal_array(lists.OTHER_HEADING_WORDS)

    def halts(line):
        return bound(F.lower(line), lambda x: F.exists(stops, lambda w: F.contains(x, w)))

    def kept(after):
        return bound(F.array_position(F.transform(after, halts), F.lit(True)), lambda cut: F.when(
            cut > 0, F.slice(after, F.lit(1), F.greatest(cut - 1, F.lit(0)).cast("int"))).otherwise(after))

    def blocks(lines):
        return F.transform(lines, lambda line, i: F.when(
            line.rlike(lists.DEGREE_LINE_PATTERN), F.concat(F.array(line), bound(F.slice(lines, i + 2, ahead), kept))))

    return F.flatten(F.array_compact(bound(text_lines(c), blocks)))


def graduation_year(education: Column, raw_text: Column, as_of_year: int) -> Column:
    """Latest plausible year in the education text or next to a degree line."""
    near = F.array_join(degree_lines(raw_text), SEPARATOR)
    text = F.concat_ws(SEPARATOR, education, near)
    return F.array_max(graduation_candidates(text, as_of_year))


def level_from_text(c: Column) -> Column:
    return (
        F.when(c.rlike(lists.ENTRY_PATTERN), "entry").when(c.rlike(lists.JUNIOR_PATTERN), "junior")
        .when(c.rlike(lists.EXECUTIVE_PATTERN), "executive").when(c.rlike(lists.SENIOR_PATTERN), "senior")
        .otherwise("entry")
    )


# -- skill evidence in a text ---------------------------------------------------------------------

def skill_aliases(skill: Column) -> Column:
    """Other spellings of a skill, lower-cased."""
    rows = ", ".join(
        f"named_struct('k', {sql_text(k)}, 'a', array({', '.join(sql_text(x) for x in a)}))"
        for k, a in lists.SKILL_ALIASES.items())
    table = F.expr(f"array({rows})")

    def named(name):
        mine = F.filter(table, lambda e: (e["k"] == name) | F.array_contains(e["a"], name))
        return F.flatten(F.transform(mine, lambda e: e["a"]))

    return bound(F.lower(skill), named)


def long_words(skill: Column) -> Column:
    return F.filter(F.split(F.lower(skill), r"\s+"), lambda w: F.length(w) > 2)


def tier_of(name: Column, words: Column, aliases: Column, lower: Column) -> Column:
    """``kw_tier`` from prepared parts: lower-case name, its longer words, aliases, lower-case text."""
    def of_hits(hits):
        return (
            F.when(F.size(words) < 2, 0.0).when(hits == F.size(words), 0.85)
            .when(hits >= F.size(words) * 0.7, 0.60).when(hits > 0, 0.35).otherwise(0.0))

    # The words are counted once, and only where neither the name nor an alias is present.
    counted = F.array(F.size(F.filter(words, lambda w: F.contains(lower, w))))
    return (
        F.when(F.contains(lower, name), 1.0)
        .when((F.size(aliases) > 0) & F.exists(aliases, lambda a: F.contains(lower, a)), 1.0)
        .when(F.size(words) < 2, 0.0).otherwise(F.get(F.transform(counted, of_hits), F.lit(0)))
    )


def kw_tier(skill: Column, text: Column, aliases: Column | None = None) -> Column:
    """1 name or alias present, .85 all longer words, .60 from 70 %, .35 any, else 0."""
    aliases = skill_aliases(skill) if aliases is None else aliases
    tier = tier_of(F.lower(skill), long_words(skill), aliases, F.lower(text))
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(tier)


def recency_factor(c: Column, as_of_year: int) -> Column:
    """Step decay by the newest range end; ongoing or undated text counts as current."""
    ends = F.transform(all_matches(c, lists.RECENCY_PATTERN, 1), F.lower)
    newest = F.array_max(F.filter(
        F.transform(ends, lambda e: e.try_cast("int")), lambda y: y.between(1970, as_of_year + 1)))
    age = F.lit(as_of_year) - newest
    return (
        F.when(F.exists(ends, lambda e: e.isin("present", "current", "now")) | newest.isNull(), 1.0)
        .when(age <= 2, 1.0).when(age <= 5, 0.85).when(age <= 10, 0.70).otherwise(0.55)
    )


def complexity_factor(c: Column, fresher: Column) -> Column:
    """Production signs raise, course work lowers; design verbs help newcomers (at most 1.25)."""
    prod = F.regexp_count(c, F.lit(lists.PRODUCTION_PATTERN))
    acad = F.regexp_count(c, F.lit(lists.ACADEMIC_PATTERN))
    base = (
        F.when(prod >= 3, 1.25).when((prod >= 1) & (acad == 0), 1.10)
        .when((acad >= 2) & (prod == 0), 0.70).when((acad >= 1) & (prod == 0), 0.80).otherwise(1.0)
    )
    return F.when(fresher & c.rlike(lists.DESIGN_PATTERN), F.least(base * 1.15, F.lit(1.25))).otherwise(base)


# A private-use character marks the skill's places while years are sought, so that the patterns are fixed; texts lose it first.
# It may stand anywhere, since a skill such as "r" or "3" is also a part of words and numbers.
_MARK = "\ue000"


def _letters(word: str) -> str:
    return f"{_MARK}?".join(word)


# Most characters between a skill and the years behind it.
_DISTANCE = 60
_NUMBER = rf"(\d[\d{_MARK}]*)"
_MAY_SPACE, _SPACE = rf"[\s{_MARK}]*", rf"{_MARK}?\s[\s{_MARK}]*"
_COUNT = rf"{_NUMBER}\+?{_MAY_SPACE}{_letters('year')}(?:{_MARK}?s)?"
_YEARS_BEFORE = rf"(?U){_COUNT}{_SPACE}(?:{_letters('of')}{_SPACE})?(?:[\w{_MARK}]+{_SPACE})?{_MARK}"
_YEARS_AFTER = rf"{_MARK}(?:[^\n\.{_MARK}]{_MARK}?){{0,{_DISTANCE}}}?{_COUNT}"
_YEAR = rf"{_letters('20')}{_MARK}?\d{_MARK}?\d|{_letters('19')}{_MARK}?\d{_MARK}?\d"
_YEARS_SPAN = rf"{_MARK}{_MAY_SPACE}\({_MARK}?({_YEAR}){_MAY_SPACE}[-–]{_MAY_SPACE}({_YEAR}|{_letters('present')}|{_letters('current')}){_MARK}?\)"


# Another one stands where a text was cut. Neither a space nor a part of a word, it is in no pattern but the distance, which is shorter than what is
# kept behind a cut.
_CUT = "\ue001"
# Places at which years may be stated for any skill; a run of digits or spaces is read once.
_PLACE = (r"(?U)(?<!\d)\d++\+?\s*+year"
          r"|(?<!\s)\s*+\((?:20|19)\d\d\s*+[-–]\s*+(?:(?:20|19)\d\d|present|current)\)")
# What may stand from such a place on before the skill begins; the word behind "year" may be one that another place ends in.
_PLACE_LEAD = r"(?U)^(?:\d++\+?\s*+year\w*+(?:\s++(?:of\s++)?(?:\w++\s++)?)?|\s*+\([^)]*+\))"


def tenure_text(c: Column) -> Column:
    """Lower-case text in which ``tenure_in`` looks for years; null where it can state none."""
    lower = F.translate(F.lower(c), _MARK + _CUT, " \ufffd")
    return F.when(F.contains(lower, F.lit("year")) | lower.rlike(r"\((?:19|20)\d\d"), lower)


def tenure_near(searched: Column, longest: Column) -> Column:
    """``tenure_text`` without what is too far from every stated number to matter for a name of up to ``longest`` characters.

    The text is divided where a place begins; of each part remain the place itself with a name's length behind it, and the
    distance with a name's length before the next place. Names are then sought in this instead of the whole text.
    """
    def shortened(parts):
        def kept(part, i):
            def cut(head):
                tail = F.when(i < F.size(parts) - 1, longest + _DISTANCE).otherwise(0)
                return F.when(F.length(part) <= head + tail, part).otherwise(
                    F.concat(F.left(part, head), F.lit(_CUT), F.right(part, tail)))

            return bound(F.when(i > 0, F.length(F.regexp_extract(part, _PLACE_LEAD, 0)) + longest).otherwise(0), cut)

        return F.array_join(F.transform(parts, kept), "")

    return bound(F.split(F.regexp_replace(searched, _PLACE, f"{_CUT}$0"), _CUT), shortened)


def tenure_in(name: Column, searched: Column, as_of_year: int) -> Column:
    """``tenure_years`` from the lower-case name and ``tenure_text``, or what ``tenure_near`` keeps of it.

    The name's places are marked by a plain replacement and found by fixed patterns: no pattern is made from data.
    """
    def years(m):
        def grab(text, pattern, group):
            return F.nullif(F.translate(F.regexp_extract(text, pattern, group), _MARK, ""), F.lit(""))

        stated = F.coalesce(
            grab(m["before"], _YEARS_BEFORE, 1).try_cast("double"), grab(m["after"], _YEARS_AFTER, 1).try_cast("double"))
        since, until = grab(m["after"], _YEARS_SPAN, 1), grab(m["after"], _YEARS_SPAN, 2)
        length = F.coalesce(until.try_cast("int"), F.lit(as_of_year)) - since.try_cast("int")
        return F.coalesce(stated, F.when(since.isNotNull(), F.greatest(length, F.lit(0)).cast("double")))

    marked = F.struct(
        F.replace(searched, name, F.concat(F.lit(_MARK), name)).alias("before"),
        F.replace(searched, name, F.concat(name, F.lit(_MARK))).alias("after"))
    found = F.when(F.contains(searched, name) & (name != "") & ~F.contains(name, F.lit(_CUT)), F.array(marked))
    return F.get(F.transform(found, years), F.lit(0))


def tenure_years(skill: Column, text: Column, as_of_year: int) -> Column:
    """Years stated for a skill: "N years of X", "X ... N years" or "X (2019-2023)"."""
    name = F.lower(skill)

    def years(searched):
        # Only a text that names the skill is shortened.
        near = F.when(F.contains(searched, name), tenure_near(searched, F.length(name)))
        return bound(near, lambda n: tenure_in(name, n, as_of_year))

    return bound(tenure_text(text), years)


# -- education ------------------------------------------------------------------------------------

def edu_keywords(c: Column) -> Column:
    lower = F.lower(F.coalesce(c, F.lit("")))
    hits = F.size(F.filter(literal_array(lists.EDUCATION_WORDS), lambda w: F.contains(lower, w)))
    return F.least(hits / 4.0, F.lit(1.0))


def degree_rank(c: Column) -> Column:
    lower = F.lower(F.coalesce(c, F.lit("")))
    rank = F.lit(0)
    for value, words in lists.DEGREE_RANKS:
        rank = F.when(F.exists(literal_array(words), lambda w: F.contains(lower, w)), value).otherwise(rank)
    return rank


def edu_level(c: Column, min_degree: Column) -> Column:
    """1 when the needed degree is met, .55 one step below, else .15."""
    name, need = F.lower(min_degree), F.lit(0)
    for value, words in lists.DEGREE_RANKS:
        need = F.when(name.isin(*words), value).otherwise(need)
    have = degree_rank(c)
    return F.when((need == 0) | (have >= need), 1.0).when(have == need - 1, 0.55).otherwise(0.15)


def major_match(c: Column, majors: Column) -> Column:
    """1 for a named major, else the best share of its longer words times .9, at least .5."""
    lower = F.lower(F.coalesce(c, F.lit("")))

    def share(m):
        parts = F.filter(F.split(F.lower(m), r"(?U)\W+"), lambda p: F.length(p) > 3)
        hits = F.size(F.filter(parts, lambda p: F.contains(lower, p)))
        return F.when(F.size(parts) > 0, hits / F.size(parts)).otherwise(0.0)

    best = F.array_max(F.transform(majors, share))
    return (
        F.when(majors.isNull() | (F.size(majors) == 0), 1.0)
        .when(F.exists(majors, lambda m: F.contains(lower, F.lower(m))), 1.0)
        .otherwise(F.greatest(best * 0.9, F.lit(0.5)))
    )


def edu_score(c: Column, min_degree: Column, majors: Column) -> Column:
    return edu_keywords(c) * edu_level(c, min_degree) * major_match(c, majors)


# -- web pages ------------------------------------------------------------------------------------

# Character references replaced in page text; the ampersand comes last.
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&copy;", "©"),
    ("&reg;", "®"), ("&amp;", "&"),
)


def unescape_common(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def strip_tags(c: Column) -> Column:
    bare = F.regexp_replace(c, "<[^>]+>", " ")
    return squeeze(unescape_common(bare))


def page_text(html: Column) -> Column:
    return strip_tags(
        F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", ""))


def page_meta(html: Column) -> Column:
    """Title and description: meta tag in either order, else the page text."""
    quote, none = "[\"']", "[^\"']*"
    a = rf"(?i)<meta\s+[^>]*name={quote}description{quote}[^>]*content={quote}({none}){quote}"
    b = rf"(?i)<meta\s+[^>]*content={quote}({none}){quote}[^>]*name={quote}description{quote}"
    meta = F.coalesce(first_match(html, a, 1), first_match(html, b, 1))
    return F.struct(
        strip_tags(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"),
        F.coalesce(F.nullif(strip_tags(meta), F.lit("")), page_text(html)).alias("description"))


def page_headings(html: Column) -> Column:
    """All heading texts of 5 to 199 characters."""
    found = F.transform(all_matches(html, r"(?is)<h[1-4][^>]*>(.*?)</h[1-4]>", 1), lambda h: strip_tags(h))
    return F.filter(found, lambda h: F.length(h).between(5, 199))


# -- privacy --------------------------------------------------------------------------------------

PHONE_RUN = r"\+?\(?\d(?:[\s\-.()]{0,2}\d){6,14}"


def scrub_pii(c: Column) -> Column:
    """Replace addresses and phone-like digit runs by type markers."""
    return F.regexp_replace(
        F.regexp_replace(c, lists.EMAIL_PATTERN, "<EMAIL_ADDRESS>"), PHONE_RUN, "<PHONE_NUMBER>")


def blind_name(rank: Column) -> Column:
    return F.concat(F.lit("Candidate #"), rank.cast("string"))


def blind_email(email: Column) -> Column:
    return F.when(
        email != "",
        F.concat(F.substring(F.element_at(F.split(email, "@"), 1), 1, 2), F.lit("***@***.***")))


# -- wording --------------------------------------------------------------------------------------

def _rated(text: Column) -> Column:
    """Sentences in lower case, each with its best verb tier, a tenth when negated."""
    parts = F.transform(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), r"\."), lambda s: F.lower(strip(s)))

    def rate(lower):
        tier = F.lit(None).cast("double")
        for value, verbs in reversed(lists.VERB_TIERS):
            forms = "|".join(f"{v[:-1]}(?:e|es|ed|ing)" if v.endswith("e") else f"{v}(?:s|ed|ing)?" for v in verbs)
            tier = F.when(lower.rlike(rf"\b(?:{forms})\b"), value).otherwise(tier)
        return F.when(lower.rlike(r"\b(?:not|never|no)\b|n't"), tier * 0.1).otherwise(tier)

    return F.transform(parts, lambda s: F.struct(s.alias("lower"), rate(s).alias("tier")))


def _tier_among(rated: Column, skill: Column) -> Column:
    mine = F.filter(rated, lambda s: F.contains(s["lower"], F.lower(skill)))
    return F.coalesce(F.array_max(F.transform(mine, lambda s: s["tier"])), F.lit(0.75))


def confidence_tier(text: Column, skill: Column) -> Column:
    """How strongly sentences with the skill speak of doing: best verb tier, a tenth when negated.

    Verbs are recognised by their forms in the sentence; there is no grammar model.
    """
    return bound(_rated(text), lambda rated: _tier_among(rated, skill))


def confidence_tiers(text: Column, skills: Column) -> Column:
    """(skill, tier) for each of an array of skills, as ``confidence_tier`` gives it; the text is cut and rated once for all of them."""
    return bound(_rated(text), lambda rated: F.transform(
        skills, lambda s: F.struct(s.alias("skill"), _tier_among(rated, s).alias("tier"))))


def _percent(c: Column) -> Column:
    return F.bround(c, 0).cast("int").cast("string")


def fit_summary(
    name: Column, job: Column, total: Column, education: Column, matched: Column, gaps: Column,
    jd_alignment: Column, weakest: Column | None = None, strongest: Column | None = None,
) -> Column:
    """Plain sentences about a scored pair. ``matched`` and ``gaps`` are ordered name lists;
    ``weakest`` and ``strongest`` are (label, score) structs of rule scores."""
    say = F.concat
    tier = F.when(total >= 75, "strong").when(total >= 50, "moderate").otherwise("weak")
    who = F.coalesce(F.nullif(name, F.lit("")), F.lit("The candidate"))
    lines = [
        say(who, F.lit(", for "), job, F.lit(": "), tier, F.lit(" match, "), _percent(total), F.lit("% in all.")),
        F.when(F.size(matched) > 0, say(
            F.lit("Found skills: "), F.array_join(F.slice(matched, 1, 5), ", "),
            F.when(F.size(matched) > 5, " and more").otherwise(""), F.lit("."))),
        F.when(F.size(gaps) > 0, say(
            F.lit("Missing skills: "), F.array_join(F.slice(gaps, 1, 3), ", "),
            F.when(F.size(gaps) > 3, " and more").otherwise(""), F.lit("."))),
    ]
    if weakest is not None:
        lines.append(F.when(weakest["score"] < 40, say(
            F.lit("Lowest rule: '"), weakest["label"], F.lit("' ("),
            _percent(weakest["score"]), F.lit("%)."))))
    if strongest is not None:
        other = F.lit(True) if weakest is None else (strongest != weakest)
        lines.append(F.when((strongest["score"] >= 80) & other, say(
            F.lit("Highest rule: '"), strongest["label"], F.lit("' ("),
            _percent(strongest["score"]), F.lit("%)."))))
    lines += [
        F.when(jd_alignment >= 70, say(
            F.lit("Work described is close to the role text ("),
            _percent(jd_alignment), F.lit("%).")))
        .when((jd_alignment > 0) & (jd_alignment < 35), say(
            F.lit("Work described is far from the role text ("),
            _percent(jd_alignment), F.lit("%)."))),
        F.when(education < 30, F.lit("Little or no education was found."))
        .when(education >= 80, F.lit("Education scores high.")),
    ]
    return F.concat_ws(" ", *lines)


def interview_questions(job: Column, matched: Column, gaps: Column, low_rule: Column | None = None) -> Column:
    """Five templated questions about gaps, strengths and the role."""
    g1, g2, s1 = F.get(gaps, F.lit(0)), F.get(gaps, F.lit(1)), F.get(matched, F.lit(0))
    wrap = F.concat
    asked = [
        wrap(F.lit("Where have you met "), g1, F.lit(" so far, and what would help you to learn it?")),
        wrap(F.lit("For this role you need "), g2, F.lit(". How have you picked up something similar before?")),
        wrap(F.lit("Which of your projects relied most on "), s1, F.lit("? What would you change in it today?")),
    ]
    if low_rule is not None:
        asked.append(wrap(F.lit("We found little about '"), low_rule, F.lit("'. What would be your first step there?")))
    asked += [
        wrap(F.lit("Why the "), job, F.lit(" role, and why now?")),
        F.lit("Which failure in a running system taught you most?"),
        F.lit("What did you learn last, and from where?"),
        F.lit("When did two teams want opposite things from you, and what came of it?"),
    ]
    return F.slice(F.array_compact(F.array(*asked)), 1, 5)


# -- manifests ------------------------------------------------------------------------------------

def manifest_names(file_name: Column, content: Column) -> Column:
    """Package names in one dependency file, in file order, without tooling noise."""
    package = F.from_json(
        content, "dependencies map<string,string>, devDependencies map<string,string>")
    keys = F.concat(
        F.coalesce(F.map_keys(package["dependencies"]), F.array().cast("array<string>")),
        F.coalesce(F.map_keys(package["devDependencies"]), F.array().cast("array<string>")))
    node = F.transform(keys, lambda k: F.element_at(F.split(F.regexp_replace(k, "^@+", ""), "/"), 1))
    lines = F.filter(trimmed_lines(content), lambda x: ~x.rlike(r"^(#|\[|-r|git\+)"))
    pip = F.transform(lines, lambda x: strip(F.element_at(F.split(x, r"[>=<!;#\s]"), 1)))
    go = F.transform(
        all_matches(content, r"(?m)^\s+(\S+)\s+v[\d.]+", 1),
        lambda m: F.element_at(F.split(F.regexp_replace(m, "/+$", ""), "/"), -1))
    toml = all_matches(content, r'"([a-zA-Z0-9_\-]+)\s*[>=<]', 1)
    names = (
        F.when(file_name == "package.json", node)
        .when(file_name.isin("requirements.txt", "Pipfile"), pip)
        .when(file_name == "go.mod", go).when(file_name == "pyproject.toml", toml)
        .otherwise(F.array().cast("array<string>")))
    noise = literal_array(lists.MANIFEST_NOISE)
    return F.filter(names, lambda n: (n != "") & ~F.array_contains(noise, F.lower(n)))
