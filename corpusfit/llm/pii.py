"""Format-preserving pseudonyms for personal data, with column functions only.

Validated values are permuted within their format by a keyed Feistel network over two counters ``(left, right)`` of
sizes ``(a, b)``: each round adds a keyed hash of one counter to the other, modulo its size, which is a permutation
of all ``a * b`` values. So equal values stay equal in all documents, different ones stay different, and ``back=True``
undoes it with the key.

| kind | valid | counters |
|---|---|---|
| card | 13 to 19 digits, separated or not, with a right check digit | halves of the digits before the check digit |
| phone | ``+country`` and national number, or a national number in parts | halves of the national digits |
| ssn | number of the US form with possible parts | area and group, serial |
| ip | four numbers up to 255 | upper and lower 16 bits |
| date | 1900 to 2099, year first with ``-`` or ``/`` (also before ``T`` and a time), or day first with ``.`` or ``/`` | days in two digits of base 270 |
| | month first with ``.`` or ``/``, where it cannot be day first | days after the 12th of a month in two digits of base 210 |
| email | name before ``@`` | (a keyed stream of letters and digits of the same shape; not undone) |

Defined cases: null stays null; numbers that fail validation stay as they are; repeated rows give equal
results; an empty table gives no rows; further columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

EDGE, END = r"(?<![\p{L}\p{N}@_])", r"(?![\p{L}\p{N}@_])"
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
IP = EDGE + r"(?<!\d\.)(?:\d{1,3}\.){3}\d{1,3}(?!\.\d)" + END
DATE = EDGE + r"(?:(?:19|20)\d\d([-/])\d\d\1\d\d(?:(?=[Tt](?:[01]\d|2[0-4]))|" + END + r")|\d\d([./])\d\d\2(?:19|20)\d\d" + END + ")"
SSN = EDGE + r"\d{3}-\d{2}-\d{4}(?!-\d)" + END
PHONE = (
    r"(?<![\p{L}\p{N}@_+])(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){2,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}"
    r"|\d{3}[.-]\d{3}[.-]\d{4})(?!-\d)" + END)
CARD = EDGE + r"(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})" + END
#: In the order in which they are tried at a place.
PATTERNS = {"email": EMAIL, "ip": IP, "date": DATE.replace(r"\1", r"\k<y>").replace(r"([-/])", "(?<y>[-/])")
            .replace(r"\2", r"\k<d>").replace(r"([./])", "(?<d>[./])"), "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(PATTERNS.values())
FIRST_DAY = "1900-01-01"
#: Number of dates in all, and of those after the 12th of a month, with the base of two digits that holds most of them.
ALL_DAYS, LATE_DAYS = (73_049, 270), (44_249, 210)


def permuted(left: Column, right: Column, a: Column, b: Column, tweak: Column, key: str, back: bool = False) -> Column:
    """Struct ``left, right``: the pair under the keyed permutation of ``a * b`` pairs (or under its inverse)."""

    def hashed(step: Column, value: Column) -> Column:
        text = F.concat_ws("|", F.lit(key), tweak, step.cast("string"), value.cast("string"))
        return F.conv(F.substring(F.sha2(text, 256), 1, 14), 16, 10).cast("long")

    def round_(pair: Column, step: Column) -> Column:
        sign = F.lit(-1 if back else 1)
        moved_left = F.pmod(pair["left"] + sign * F.pmod(hashed(step, pair["right"]), a), a)
        moved_right = F.pmod(pair["right"] + sign * F.pmod(hashed(step, pair["left"]), b), b)
        even = step % 2 == 0
        return F.struct(
            F.when(even, moved_left).otherwise(pair["left"]).alias("left"),
            F.when(even, pair["right"]).otherwise(moved_right).alias("right"))

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(steps, start, round_)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _padded(value: Column, width: Column) -> Column:
    return F.lpad(value.cast("string"), width, "0")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once, however often it is read."""
    return F.transform(F.array(value), use)[0]


def digits_permuted(digits: Column, tweak: str, key: str, back: bool) -> Column:
    """A digit string of 2 to 18 digits under a permutation of all strings of its length."""

    def use(d: Column) -> Column:
        n = F.length(d)
        u = F.floor(n / 2).cast("int")
        v = n - u
        pair = permuted(
            F.substring(d, F.lit(1), u).cast("long"), F.substring(d, u + 1, v).cast("long"), _power(u), _power(v),
            F.concat(F.lit(tweak), n.cast("string")), key, back)
        return _let(pair, lambda p: F.concat(_padded(p["left"], u), _padded(p["right"], v)))

    return _let(digits, use)


def _laid_out(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced by ``digits`` in order."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def step(state: Column, char: Column) -> Column:
        is_digit = char.rlike("^[0-9]$")
        return F.struct(
            (state["at"] + is_digit.cast("int")).alias("at"),
            F.concat(state["out"], F.when(is_digit, F.substring(digits, state["at"], F.lit(1))).otherwise(char)).alias("out"))

    return F.aggregate(F.split(layout, ""), start, step, lambda s: s["out"])


def _only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _card(m: Column, key: str, back: bool) -> Column:
    def use(d: Column) -> Column:
        body = digits_permuted(F.substring(d, F.lit(1), F.length(d) - 1), "card", key, back)
        full = _let(body, lambda x: F.concat(
            x, F.filter(F.sequence(F.lit(0), F.lit(9)), lambda c: F.call_function("luhn_check", F.concat(x, c.cast("string"))))[0].cast("string")))
        return F.when(F.call_function("luhn_check", d), _let(full, lambda x: _laid_out(m, x)))

    return _let(_only_digits(m), use)


def _phone(m: Column, key: str, back: bool) -> Column:
    country = F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-]))?", 0)

    def use(c: Column) -> Column:
        rest = F.substring(m, F.length(c) + 1, F.length(m))
        return F.concat(c, _let(rest, lambda r: _laid_out(r, digits_permuted(_only_digits(r), "phone", key, back))))

    return _let(country, use)


def _ssn(m: Column, key: str, back: bool) -> Column:
    area, group, serial = (F.substring(m, F.lit(at), F.lit(n)).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    # 898 areas, without 000, 666 and 900 upwards, times 99 groups; 9999 serials.
    place = (area - 1 - (area > 666).cast("int")) * 99 + group - 1
    pair = permuted(place, serial - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"), key, back)

    def shown(p: Column) -> Column:
        number = F.floor(p["left"] / 99).cast("int") + 1
        number = number + (number >= 666).cast("int")
        return F.concat_ws("-", _padded(number, F.lit(3)), _padded(p["left"] % 99 + 1, F.lit(2)), _padded(p["right"] + 1, F.lit(4)))

    return F.when(valid, _let(pair, shown))


def _ip(m: Column, key: str, back: bool) -> Column:
    def use(part: Column) -> Column:
        valid = F.forall(part, lambda p: p.cast("int") < 256) & F.forall(part, lambda p: (F.length(p) == 1) | ~p.startswith("0"))
        half = [part[k].cast("int") * 256 + part[k + 1].cast("int") for k in (0, 2)]
        pair = permuted(half[0], half[1], F.lit(65536), F.lit(65536), F.lit("ip"), key, back)
        return F.when(valid, _let(pair, lambda p: F.concat_ws(".", *[
            F.floor(v / 256).cast("string") if high else (v % 256).cast("string")
            for v in (p["left"], p["right"]) for high in (True, False)])))

    return _let(F.split(m, r"\."), use)


def _date(m: Column, key: str, back: bool) -> Column:
    year_first = m.rlike(r"^[0-9]{4}")
    mark = F.when(year_first, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
    dashed = F.translate(m, "./", "--")
    day = F.when(year_first, F.try_to_date(dashed, "yyyy-MM-dd")).otherwise(F.try_to_date(dashed, "dd-MM-yyyy"))
    # Read only where the day-first form fails, so always after the 12th; such dates are moved among themselves to be read alike again.
    late = F.when(~year_first, F.try_to_date(dashed, "MM-dd-yyyy"))
    first = F.lit(FIRST_DAY).cast("date")

    def moved(n: Column, total: int, size: int, tweak: str) -> Column:
        whole = size * size
        last = total - whole  # those that do not fill the square; they are turned among themselves
        base = F.lit(size)
        pair = permuted(F.floor(n / size), n % size, base, base, F.lit(tweak), key, back)
        turn = F.pmod(F.conv(F.substring(F.sha2(F.concat(F.lit(key), F.lit(f"|{tweak}")), 256), 1, 12), 16, 10).cast("long"), F.lit(last))
        return F.when(n < whole, _let(pair, lambda p: p["left"] * size + p["right"])).otherwise(
            F.lit(whole) + F.pmod(n - whole + F.lit(-1 if back else 1) * turn, F.lit(last)))

    def shown(n: Column) -> Column:
        at = F.date_add(first, n.cast("int"))
        parts = [F.date_format(at, p) for p in ("yyyy", "MM", "dd")]
        return F.when(year_first, F.concat(parts[0], mark, parts[1], mark, parts[2])).otherwise(
            F.concat(parts[2], mark, parts[1], mark, parts[0]))

    def before(months: Column) -> Column:
        """Late days before a month, which is counted from the first."""
        return F.datediff(F.add_months(first, months.cast("int")), first) - 12 * months

    def shown_late(n: Column) -> Column:
        # A month has 18.4 late days and never strays far from it: it is one of the five about that place.
        about = F.floor(n * 2400 / LATE_DAYS[0])
        months = F.filter(F.sequence(about - 2, about + 2), lambda k: before(k) <= n)
        return _let(F.array_max(months), lambda k: F.date_format(
            F.date_add(F.add_months(first, k.cast("int")), (n - before(k) + 12).cast("int")), "MM-dd-yyyy"))

    months = (F.year(late) - 1900) * 12 + F.month(late) - 1
    rank = (before(months) + F.dayofmonth(late) - 13).cast("long")
    any_day = _let(F.datediff(day, first).cast("long"), lambda n: F.when(n.isNotNull(), _let(moved(n, *ALL_DAYS, "date"), shown)))
    late_day = _let(rank, lambda n: F.when(n.isNotNull(), _let(moved(n, *LATE_DAYS, "late"), lambda x: F.replace(shown_late(x), F.lit("-"), mark))))
    return F.coalesce(any_day, late_day)


def _email(m: Column, key: str, back: bool) -> Column:
    name = F.substring_index(m, "@", 1)
    if back:
        return F.lit(None).cast("string")
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256)

    def use(s: Column) -> Column:
        def char(c: Column, k: Column) -> Column:
            drawn = F.substring(s, k % 64 + 1, F.lit(1))
            letter = F.translate(drawn, "0123456789", "ghjkmnpqrs")
            digit = F.translate(drawn, "abcdef", "024681")
            return F.when(c.rlike(r"^\p{L}$"), letter).when(c.rlike(r"^\p{N}$"), digit).otherwise(c)

        return F.concat(F.array_join(F.transform(F.split(name, ""), char), ""), F.lit("@"), F.substring_index(m, "@", -1))

    return _let(stream, use)


RULES = {"email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _replaced(m: Column, key: str, back: bool) -> Column:
    """Struct ``kind, value`` of a match; kind is null where validation fails, and the value is then the match."""
    kind, value = None, None
    for name, pattern in PATTERNS.items():
        hit = m.rlike(f"^(?:{pattern})$")
        kind = F.when(hit, F.lit(name)) if kind is None else kind.when(hit, F.lit(name))
    def use(k: Column) -> Column:
        out = F.when(k == "email", RULES["email"](m, key, back))
        for name in list(PATTERNS)[1:]:
            out = out.when(k == name, RULES[name](m, key, back))
        return _let(out, lambda v: F.struct(
            F.when(v.isNotNull(), k).alias("kind"), F.coalesce(v, m).alias("value")))

    return _let(kind, use)


def pseudonymised(docs: DataFrame, key: str, text: str = "text", back: bool = False, found: str = "__found") -> DataFrame:
    """``docs`` with ``text`` rewritten, and an array ``found`` of (kind, value) in the order of the text."""
    old = F.col(text)
    may_hold = old.rlike("[0-9]|@")
    matches = F.when(may_hold, F.regexp_extract_all(old, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    marked = docs.withColumn(found, F.transform(matches, lambda m: _replaced(m, key, back)))
    pieces = F.split(old, ANY, -1)
    values = F.concat(F.transform(F.col(found), lambda f: f["value"]), F.array(F.lit("")))
    new = F.when(F.size(found) > 0, F.array_join(F.zip_with(pieces, values, lambda p, v: F.concat(p, v)), "")).otherwise(old)
    return marked.withColumn(text, new)


def replace_personal_data(docs: DataFrame, key: str) -> DataFrame:
    """The documents with pseudonyms in their texts and all other columns as they are."""
    return pseudonymised(docs, key).drop("__found")


def with_counts(docs: DataFrame, key: str) -> DataFrame:
    """``doc_id``, the rewritten text, and the number of values replaced by kind."""
    marked = pseudonymised(docs.select("doc_id", "text"), key)

    def count(kind: str) -> Column:
        return F.coalesce(F.size(F.filter("__found", lambda f: f["kind"] == kind)), F.lit(0)).cast("long").alias(f"n_{kind}")

    return marked.select("doc_id", "text", *[count(kind) for kind in PATTERNS])
