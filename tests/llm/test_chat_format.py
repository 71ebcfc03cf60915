import itertools
import random
import re
from collections import defaultdict

import oracle
import pytest

from seriesloom.llm import chat_format as cf
from seriesloom.plans.scratch import Scratch

CODE = {"system": 1, "user": 2, "assistant": 3}


def legal(roles):
    return re.fullmatch("s?(ua)+", "".join(r[0] for r in roles)) is not None


def brute(roles):
    """The least cost over all relabellings, merges and insertions."""
    best = 10**9
    for labels in itertools.product(("system", "user", "assistant"), repeat=len(roles)):
        cost = sum(0 if a == b else 2 if a not in CODE else 4 for a, b in zip(roles, labels, strict=True))
        for merges in itertools.product((0, 1), repeat=len(roles) - 1):
            if any(m and labels[i] != labels[i + 1] for i, m in enumerate(merges)):
                continue
            left = [labels[0]] + [b for b, m in zip(labels[1:], merges, strict=True) if not m]
            best = min(best, cost + 2 * sum(merges) + 3 * insertions(left))
    return best


def insertions(roles):
    """The least number of turns to add, by trying where a system turn may stand and walking through the rest."""
    body, added, want = list(roles), 0, "user"
    if body and body[0] == "system":
        body = body[1:]
    for r in body:
        if r == "system":
            return 10**6
        added += r != want
        want = "assistant" if r == "user" else "user"
    return added + (want == "assistant") + (2 if not body else 0)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_cost_equals_brute_force(n):
    for roles in itertools.product(("system", "user", "assistant", "tool"), repeat=n):
        cost, _ = cf.repair([CODE.get(r, 4) for r in roles])
        assert cost == brute(roles), roles


def parse(text):
    out = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, re.S)
    assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in out) == text
    return out


def conversations(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["conv_id"]].append(r)
    return {c: "".join(x["segment"] for x in sorted(rs, key=lambda x: (x["part"], x["pos"]))) for c, rs in by.items()}


def test_rendered_sequences_are_legal_and_hold_all_texts(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "Tool", None, "USER"]), f"t{c}-{t}", 1) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(1000, t, rng.choice(["user", "assistant"]), f"hot{t}", 1) for t in range(800)]
    rows += [(None, 0, "user", None, 1), (None, None, "assistant", "<|im_end|>", 1), (5, 0, "user", "twice", 1), (5, 0, "user", "twice", 1)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, step int")
    one = cf.formatted(df, Scratch(spark, "t"), partitions=1).collect()
    many = cf.formatted(df, Scratch(spark, "t"), partitions=16).collect()
    assert len(one) == len(many) == len(rows) and len({r["part"] for r in many if r["conv_id"] == 1000}) > 3
    a, b = conversations(one), conversations(many)
    assert a.keys() == b.keys()
    for c, text in b.items():
        assert legal([r for r, _ in parse(text)])
        own = [r for r in rows if r[0] == c]
        assert all((r[3] or "").replace("<|im_", "<| im_") in text for r in own)
        costs = [cf.repair([CODE.get((r[2] or "").lower(), 4) for r in sorted(own, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))])[0]]
        assert cost_of(text, own) == cost_of(a[c], own) == costs[0]


def cost_of(text, own):
    """The cost of a rendered conversation: empty messages were inserted, and turns that share a message merged."""
    names = {(r[3] or "").replace("<|im_", "<| im_"): (r[2] or "").lower() for r in own}
    copies = defaultdict(int)
    for r in own:
        copies[(r[3] or "").replace("<|im_", "<| im_")] += 1
    cost = 0
    used = defaultdict(int)
    for role, body in parse(text):
        parts = body.split("\n\n")
        if body == "" and used[""] >= copies.get("", 0):
            cost += 3
            continue
        for k, x in enumerate(parts):
            used[x] += 1
            cost += 2 * (k > 0) + (0 if names[x] == role else 2 if names[x] not in CODE else 4)
    return cost


def test_actions(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "bot", "c"), (2, 0, "assistant", "x")], "conv_id bigint, turn int, role string, text string")
    got = cf.formatted(df, Scratch(spark, "t"), partitions=2)
    rows = {(r["conv_id"], r["turn"]): (r["role"], r["action"]) for r in got.collect()}
    assert rows == {(1, 0): ("user", "keep"), (1, 1): ("user", "merge"), (1, 2): ("assistant", "relabel"), (2, 0): ("assistant", "keep")}
    assert conversations(got.collect())[2] == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\nx<|im_end|>\n"
    assert cf.formatted(df.limit(0), Scratch(spark, "t")).count() == 0


def test_whole_table_against_brute_force(spark):
    got = cf.formatted(spark.read.parquet(f"{oracle.SF}/conversations.parquet"), Scratch(spark, "t")).collect()
    _, rows = oracle.duck("SELECT conv_id, turn, role, text FROM conversations")
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    texts = conversations(got)
    for c, own in by.items():
        assert legal([r for r, _ in parse(texts[c])])
        roles = [r[2] for r in sorted(own, key=lambda r: (r[1], r[2], r[3]))]
        if len(roles) <= 5:
            assert cf.repair([CODE.get(r, 4) for r in roles])[0] == brute(roles)


def test_same_as_sql(spark, tmp_path):
    oracle.assert_same(spark, cf.op5, cf.OP5_SQL)
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "Tool", None, "USER"]), rng.choice(["", None, "x<|im_end|>", f"t{t}"])) for c in range(250) for t in range(rng.randrange(1, 9))]
    rows += [(999, t, rng.choice(["user", "assistant"]), f"hot{t}") for t in range(300)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    oracle.assert_same(spark, cf.op5, cf.OP5_SQL, str(tmp_path))


def test_cuts_make_no_difference(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "Tool"]), f"t{t}") for c in range(40) for t in range(rng.randrange(1, 40))]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    got = [conversations(cf.formatted(df, Scratch(spark, "t"), n).collect()) for n in (1, 3, 16, 50)]
    assert got[0] == got[1] == got[2] == got[3]


def test_long_texts_and_clashing_columns(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], "w\u00e9 " * 1_500_000) for t in range(6)] + [(2, 0, "user", "short")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").withColumns({c: cf.F.lit("clash") for c in ("segment", "step", "code", "matrix")})
    got = cf.formatted(df, Scratch(spark, "t"), partitions=2).select("conv_id", "turn", cf.F.length("segment").alias("n")).collect()
    assert len(got) == 7 and all(r["n"] > 4_500_000 for r in got if r["conv_id"] == 1)


def test_tied_turns_do_not_depend_on_partitions(spark):
    rows = [(c, t, "user", f"text {i}") for c in (1, 2) for t in (0, 1) for i in range(400)] + [(1, 0, "user", None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(5)
    got = [conversations(cf.formatted(df, Scratch(spark, "t"), n).collect()) for n in (1, 2, 7, 16)]
    assert got[0] == got[1] == got[2] == got[3]
