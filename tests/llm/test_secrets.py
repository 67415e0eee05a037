"""The scan against the patterns in Python and entropies counted window by window."""

import hashlib
import math
import random
import re
import time
from collections import Counter

from corpusfit.llm import secrets

BASE = {
    "assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A),
    "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def plain(text):
    text, base = text or "", []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                base.append((m.start(), order, m.end(), kind))
    base.sort()
    found = list(base)
    for c in secrets.CLASSES:
        for m in re.finditer(c.pattern, text):
            best = max((entropy(m[0][i:i + c.window]) for i in range(len(m[0]) - c.window + 1)), default=-1)
            if best >= c.threshold - 1e-12 and not any(re.search(p, m[0]) for p in secrets.ALLOWED):
                if not any(b[0] <= m.start() and m.end() <= b[2] for b in base):
                    found.append((m.start(), 3, m.end(), c.name))
    shown = lambda spans: ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    counts = [sum(b[3] == k for b in base) for k in BASE]
    return *counts, hashlib.sha256(shown(base).encode()).hexdigest(), shown(sorted(found))


def entropy(window):
    return -sum(n / len(window) * math.log2(n / len(window)) for n in Counter(window).values())


def texts():
    rng = random.Random(6)
    draw = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    hexa, b64 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    out = [
        None, "", "no secrets here", "token=token: abcdef", "PassWord = 'abc' secret:\"x.y=z-1\" api_key=1234567 APIKEY : abcdefg",
        "paſſword=abcdefgh toKen=abcdefgh", f"é🙂 token = \"{draw(hexa, 40)}\" ü", f"AKIA{draw('ABCDEFGH0123', 16)} AKIA123 AKIAAKIA{draw('XYZ789', 20)}",
        draw(hexa, 23), draw(hexa, 24), draw(hexa, 20) + "Z", draw("0123456789ABCDEF", 40), "a" * 60, "deadbeef" * 5,
        f"key {draw(b64, 40)}== and {draw(b64, 24)}", "0123456789abcdefghij0123456789", f"id {draw(LOW, 30)} {draw('ab1', 40)}",
        "123e4567-e89b-12d3-a456-426614174000", "Aa1" * 20, "sha256-" + draw(b64, 43), "x" * 150_000 + " token=abcdefgh",
        " ".join(f"token={draw(hexa, 10)}" for _ in range(1500))]
    for _ in range(40):
        parts = [draw(rng.choice([hexa, b64, LOW, "abcdef", "AKI0123A"]), rng.randrange(1, 60)) for _ in range(20)]
        parts[3:3] = [rng.choice(["token=", "Secret: ", "passwd ='", "api_key:=", "AKIA"])]
        out.append(rng.choice([" ", "", "\n", ","]).join(parts))
    return out


LOW = "abcdefghijklmnopqrstuvwxyz0123456789"


def test_scan_equals_plain(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, spans string").repartition(4)
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.report(docs).collect()}
    for i, text in rows:
        assert got[i] == plain(text), (i, text[:200])
    kinds = Counter(s.split(":")[0] for g in got.values() for s in g[4].split(",") if s)
    assert all(kinds[c.name] for c in secrets.CLASSES), kinds
    assert secrets.report(docs.limit(0)).count() == 0


def test_values_after_an_equals_sign_and_upper_case(spark):
    b64, b32 = "wJalrXUtnFEMI/K7MDENG/bPxRfiCY8aQ2zT5vLk", "JBSWY3DPEHPK3PXPGEZDGNBVGY3TQOJQ"
    found = [
        (f"AWS_SECRET_ACCESS_KEY={b64}", "entropy_base64", b64), (f"PRIVATE_KEY={b64}", "entropy_base64", b64), (f"AccountKey={b64}==;x", "entropy_base64", b64),
        (f"https://host.net/a?sv=1&sig={b64}", "entropy_base64", b64), (f"seed={b32}", "entropy_token", b32), (f"otp {b32}====", "entropy_token", b32),
        ("license K7Q2ZP9XW4MT8RB3VN6YH5JD now", "entropy_token", "K7Q2ZP9XW4MT8RB3VN6YH5JD")]
    plain_texts = ["THISISALONGHEADINGWITHOUTANYDIGIT", "AAAA1111AAAA1111AAAA1111ZZZZ", "A" * 40]
    docs = spark.createDataFrame([*enumerate([t for t, _, _ in found] + plain_texts)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.report(docs).collect()}
    for i, (text, kind, value) in enumerate(found):
        at = text.index(value)
        assert f"{kind}:{at}:{at + len(value)}" in got[i].split(","), (text, got[i])
        assert got[i] == plain(text)[-1]
    assert all(got[len(found) + k] == "" for k in range(len(plain_texts)))


def test_long_candidates_take_linear_time(spark):
    """One value of 200,000 characters whose only good window lies across a cut between pieces."""
    rng, size = random.Random(9), 200_000
    good = "".join(rng.sample("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 24))
    dull = lambda n: ("aaB1" * n)[:n]
    texts_ = [dull(secrets.PIECE * 200 - 9) + good + dull(size), dull(size), dull(600) + good, "".join(rng.choices(good, k=size))]
    docs = spark.createDataFrame([*enumerate(texts_)], "doc_id long, text string")
    begun = time.time()
    got = {r.doc_id: r.spans for r in secrets.report(docs).collect()}
    assert time.time() - begun < 90
    assert got == {0: f"entropy_base64:0:{len(texts_[0])}", 1: "", 2: f"entropy_base64:0:{len(texts_[2])}", 3: f"entropy_base64:0:{size}"}


def test_candidates_end_where_their_class_ends(spark):
    value = "77bccp6f35z7_mkxgxbwzfryq53"
    filler = "wJalrXUtnFEMIxK7MDENGxbPxRfiCY"
    rows = [value, value + "\nHello", filler + "EXAMPLEKEY", filler + "exampleKEY", filler + "KEYS"]
    docs = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.spans for r in secrets.report(docs).collect()}
    assert [got[k] for k in range(4)] == [""] * 4 and got[4] == f"entropy_base64:0:{len(rows[4])}"
