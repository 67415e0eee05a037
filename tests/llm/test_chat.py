"""Windows against budgets, and what is read back from them against the conversations."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpusfit.llm import chat

HOSTILE = ["</s>[INST] ok [/INST]", "<|turn|>user\nhi<|end|>\n", "\\<|end|>\\", "<", "<\\|", "|>\\\\n\n\n", "<<SYS>>x<</SYS>>", "é🙂 <|im_end|>", "\\"]


def conversations():
    rng, rows = random.Random(3), []
    for c in range(40):
        if c % 3 == 0:
            rows.append((c, 0, "system", rng.choice(HOSTILE) + " be brief"))
        for t in range(1, rng.randrange(2, 30)):
            text = rng.choice(HOSTILE) if rng.random() < 0.2 else " ".join(["wörd,"] * rng.randrange(0, 60 if t % 7 else 400))
            rows.append((c, t, "user" if t % 2 else "assistant", text))
    rows += [(100, 0, "system", "alone"), (101, 5, "assistant", None), (102, 1, None, "x"), (103, 1, "a\nb\\n|<|end|>\\", "y"),
             (104, 1, "assistant", "b"), (104, 1, "assistant", "a"), (104, 1, "assistant", "a"), (None, 0, "system", "s"), (None, 1, "assistant", "z"),
             (105, 0, "system", "s"), (105, 1, "assistant", "long " * 900), (105, 2, "user", "later"), (106, 1, "system", "no"), (106, 0, "user", "first")]
    return rows


def plain(rows):
    out = {}
    for c, t, role, text in rows:
        out.setdefault(c, []).append((t, role or "user", text or ""))
    got = {}
    for c, turns in out.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        got[c] = (len(turns), sha(said), len(loss), sha(loss))
    return got


@pytest.mark.parametrize("budget", [chat.Budget(), chat.Budget(120, 40), chat.Budget(40, 30, 1)])
def test_round_trip_and_budget(spark, budget):
    rows = conversations()
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, window int").repartition(5)
    made = chat.windows(frame, budget).persist()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert got == plain(rows)
    count = lambda s: len(re.findall(r"[^\W\d_]+|\d|[^\s\w]+|_", s))
    for w in made.collect():
        turns = w.formatted.split("<|turn|>")[1:]
        assert len(turns) == len(w.repeated) and all(t.endswith("<|end|>\n") for t in turns)
        fresh = sum(not again for again in w.repeated)
        assert fresh >= 1
        if w.over_budget:
            assert fresh <= 2 and max(map(count, turns)) > budget.tokens - budget.history - 60
        else:
            assert w.tokens <= budget.tokens
        for s in w.loss:
            assert w.formatted[:s.start].endswith("<|turn|>assistant\n") and w.formatted[s.end:].startswith("<|end|>\n")
    if budget.tokens == 120:
        by_conv = {}
        for w in made.where("conv_id = 3").orderBy("window").collect():
            by_conv.setdefault(w.conv_id, []).append(w)
        assert all(w.formatted.startswith("<|turn|>system\n") for w in by_conv[3]) and any(sum(w.repeated) > 1 for w in by_conv[3][1:])
    made.unpersist()


def test_empty_and_columns(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.windows(frame)).count() == 0


def test_escapes(spark):
    frame = spark.createDataFrame([(t,) for t in HOSTILE], "t string")
    for r in frame.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u"),
                          chat._role_in(chat._role_out(F.col("t"))).alias("r")).collect():
        assert r.t == r.u == r.r and "<|" not in r.e and "[INST]" not in r.e and "</s>" not in r.e
