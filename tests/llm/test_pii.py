"""Pseudonyms against a plain implementation of the network, and round trips."""

import datetime
import hashlib
import re

from pyspark.sql import functions as F

from corpusfit.llm import pii

KEY = "k1"


def network(left, right, a, b, tweak):
    def hashed(step, value):
        return int(hashlib.sha256(f"{KEY}|{tweak}|{step}|{value}".encode()).hexdigest()[:14], 16)

    for step in range(pii.ROUNDS):
        if step % 2 == 0:
            left = (left + hashed(step, right)) % a
        else:
            right = (right + hashed(step, left)) % b
    return left, right


def digits(text, tweak):
    n = len(text)
    u = n // 2
    x, y = network(int(text[:u]), int(text[u:]), 10 ** u, 10 ** (n - u), f"{tweak}{n}")
    return f"{x:0{u}d}{y:0{n - u}d}"


def luhn(text):
    d = [int(c) for c in text][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def card(text):
    body = digits(text[:-1], "card")
    return next(body + str(c) for c in range(10) if luhn(body + str(c)))


CARDS = ["4111111111111111", "5500005555555559", "378282246310005", "6011000990139424"]
assert all(map(luhn, CARDS))


def run(spark, texts, back=False):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_card string")
    return [r.text for r in pii.pseudonymised(docs, KEY, back=back).orderBy("doc_id").collect()]


def test_values_follow_the_network(spark):
    ip = network(97 * 256 + 51, 17 * 256 + 173, 65536, 65536, "ip")
    area = network((123 - 1) * 99 + 45 - 1, 6789 - 1, 898 * 99, 9999, "ssn")
    number = area[0] // 99 + 1
    day = (datetime.date(1984, 2, 29) - datetime.date(1900, 1, 1)).days
    moved = network(day // 270, day % 270, 270, 270, "date")
    date = datetime.date(1900, 1, 1) + datetime.timedelta(days=moved[0] * 270 + moved[1])
    phone = digits("9745553436", "phone")
    cases = {
        CARDS[0]: card(CARDS[0]), CARDS[2]: card(CARDS[2]),
        "4111 1111 1111 1111": " ".join(re.findall("....", card(CARDS[0]))),
        "4111111111111112": "4111111111111112",
        "97.51.17.173": f"{ip[0] // 256}.{ip[0] % 256}.{ip[1] // 256}.{ip[1] % 256}", "97.51.17.273": "97.51.17.273",
        "123-45-6789": f"{number + (number >= 666):03d}-{area[0] % 99 + 1:02d}-{area[1] + 1:04d}", "000-45-6789": "000-45-6789",
        "1984-02-29": date.isoformat(), "29.02.1984": date.strftime("%d.%m.%Y"), "1983-02-29": "1983-02-29",
        "+1 (974) 555-3436": f"+1 ({phone[:3]}) {phone[3:6]}-{phone[6:]}",
        "974-555-3436": f"{phone[:3]}-{phone[3:6]}-{phone[6:]}",
    }
    texts = [f"Été {k}, and {k}!!\n{k}" for k in cases]
    assert run(spark, texts) == [f"Été {v}, and {v}!!\n{v}" for v in cases.values()]


def test_round_trip_and_shape(spark):
    days = [(datetime.date(1900, 1, 1) + datetime.timedelta(days=97 * k)).isoformat() for k in range(750)]
    days += [(datetime.date(2099, 12, 31) - datetime.timedelta(days=k)).isoformat() for k in range(150)]
    texts = [" ".join(days), " ".join(CARDS), "1.2.3.4 255.255.255.255 +44 20 7946 0958 665-01-0001 667-99-9999 899-01-0001",
             "(212) 555-0123 at 31/12/1999, 07.08.2001"]
    coded = run(spark, texts)
    assert run(spark, coded, back=True) == texts
    assert len(set(coded[0].split())) == len(days) and all(luhn(c) for c in coded[1].split())
    assert [re.sub("[0-9]", "9", t) for t in coded[:2]] == [re.sub("[0-9]", "9", t) for t in texts[:2]]


def test_mail_names_and_untouched_text(spark):
    plain = ["", None, "No numbers.", "version 3. CC BY-NC 4.0, 12345 and 1234567890123", "a@b", "9" * 40, "x" * 200_000]
    assert run(spark, plain) == plain
    a, b = run(spark, ["Mail une.92@mail6.example.com now", "une.92@mail6.example.com"])
    assert a == f"Mail {b} now" and re.fullmatch(r"[a-z]{3}\.[0-9]{2}@mail6\.example\.com", b) and not b.startswith("une.92")


def test_counts_columns_and_empty(spark):
    docs = spark.createDataFrame(
        [(1, f"{CARDS[0]} {CARDS[0]} 1.2.3.4", 5, "z"), (2, None, 6, "y")], "doc_id long, text string, n_card int, kind string")
    rows = {r.doc_id: r for r in pii.with_counts(docs, KEY).collect()}
    assert (rows[1].n_card, rows[1].n_ip, rows[1].n_email, rows[2].n_card, rows[2].text) == (2, 1, 0, 0, None)
    kept = pii.replace_personal_data(docs, KEY)
    assert kept.columns == docs.columns and kept.where(F.col("n_card") == 6).first().kind == "y"
    assert pii.with_counts(docs.limit(0), KEY).count() == 0


def test_month_first_dates_and_timestamps(spark):
    late = [datetime.date(1900, 1, 1) + datetime.timedelta(days=k) for k in [*range(0, 73_049, 61), *range(72_700, 73_049)]]
    late = sorted({d for d in late if d.day > 12})
    texts = [" ".join(d.strftime("%m/%d/%Y") for d in late), "born 03/25/1984, 03.25.1984", "at 1984-03-07T10:00:00Z and 1984/03/07t23:59",
             "1984-03-07Tx 1984-03-07T99 13/32/1984 1984-02-30T10:00"]
    coded = run(spark, texts)
    assert coded[3] == texts[3] and run(spark, coded, back=True) == texts
    got = [datetime.datetime.strptime(t, "%m/%d/%Y").date() for t in coded[0].split()]
    assert len(set(got)) == len(late) and all(d.day > 12 for d in got) and sum(a == b for a, b in zip(got, late)) < 5
    assert re.fullmatch(r"born \d\d/\d\d/\d{4}, \d\d\.\d\d\.\d{4}", coded[1]) and "03/25/1984" not in coded[1] and "03.25.1984" not in coded[1]
    assert coded[2] == "at {}T10:00:00Z and {}t23:59".format(*run(spark, ["1984-03-07", "1984/03/07"]))
    assert "1984-03-07" not in coded[2]
