"""Structure repair against a plain dynamic program over whole conversations."""

import hashlib
import random
import re

import pytest

from fieldmark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain_rows(rows):
    """Rows of a conversation in order, nulls as one space, with their faults."""
    said = sorted(((t is not None, t or 0, t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows), key=lambda v: (v[0], v[1], v[3], v[4]))
    seen, out = set(), []
    for _, _, turn, role, text in said:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def plain_repair(rows):
    rows = plain_rows(rows)

    def closed(best):
        for _ in range(4):
            for q, (c, x, o) in list(best.items()):
                for role in ("user", "assistant"):
                    if (r := STEPS.get((q, role[0]))) is not None:
                        new = (c + 3, x + "I", (*o, f"{role}:"))
                        best[r] = min(best.get(r, new), new)
        return best

    best = closed({0: (0, "", ())})
    for _, role, text, fault in rows:
        new = {}

        def offer(q, w):
            new[q] = min(new.get(q, w), w)

        for q, (c, x, o) in best.items():
            offer(q, (c + 4, x + "D", o))
            if fault not in ("blank", "duplicate"):
                more = 3 if fault else 0
                if (r := STEPS.get((q, role[:1]))) is not None:
                    offer(r, (c + more, x + "K", (*o, f"{role}:{text}")))
                for given in ("user", "assistant"):
                    if (r := STEPS.get((q, given[0]))) is not None:
                        offer(r, (c + 3 + more, x + "R", (*o, f"{given}:{text}")))
        best = closed(new)
    cost, audit, lines = min(best[q] for q in (0, 3) if q in best)
    turns = [t for t, *_ in rows if t is not None]
    initials = [r[:1] for _, r, _, _ in rows]
    faults = [f for *_, f in rows]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return {"gaps": gaps, "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"), "illegal": illegal, "cost": cost, "audit": audit,
            "n_turns": len(lines), "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def conversations(seed, ids, most):
    dice = random.Random(seed)
    texts = ["Yes.", "No", "a b!", "", " \n", None, "what?", "x.\t", "é\n?", "…", "same."] + [f"t{i}." for i in range(40)]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for c in ids:
        for t in range(dice.randint(1, most)):
            turn = None if dice.random() < 0.05 else t + (3 if dice.random() < 0.1 else 0)
            role = roles[t % 2] if dice.random() < 0.7 else dice.choice(roles)
            rows += [(c, turn, role, dice.choice(texts))] * (2 if dice.random() < 0.08 else 1)
    return rows


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in repair.digest(repair.repair(df)).collect()}
    assert got == {c: plain_repair([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_repairs_are_the_cheapest(spark):
    rows = conversations(5, [None, *range(-1, 150)], 9)
    random.Random(1).shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("partitions", ["1", "23"])
def test_a_conversation_over_many_tasks(spark, partitions):
    rows = conversations(7, [4], 1500) + conversations(8, [3, 5], 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = repair._parts(repair.Machine(), repair._faults(spark.createDataFrame(rows, SCHEMA), None)).where("seg IS NOT NULL AND conv_id = 4")
        assert (parts.count() > 5) == (partitions == "23")
        check(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_audits_give_grammatical_roles(spark):
    rows = conversations(11, range(60), 8)
    turns = repair.repair(spark.createDataFrame(rows, SCHEMA)).where("position >= 0").collect()
    for c in range(60):
        said = "".join(r["role"][0] for r in sorted((r for r in turns if r["conv_id"] == c), key=lambda r: r["position"]))
        assert re.fullmatch("(s?(ua)+)?", said)


def test_equal_rows_travel_as_one(spark):
    rows = [(1, 0, "user", "Hi.")] * 500 + [(1, 1, "assistant", "Yes.")] + [(1, t, "user", "Hi.") for t in range(2, 40)]
    assert repair._faults(spark.createDataFrame(rows, SCHEMA), None).count() == 40
    check(spark, rows)


def test_lost_and_empty(spark):
    df = spark.createDataFrame([(1, None, "", "", 0), (2, 0, "user", "a.", 2)], f"{SCHEMA}, copies int")
    got = {r["conv_id"]: r for r in repair.digest(repair.repair(df, copies="copies")).collect()}
    assert (got[1]["cost"], got[1]["audit"], got[1]["gaps"], got[1]["repaired_sha256"]) == (0, "", 0, hashlib.sha256().hexdigest())
    assert (got[2]["audit"], got[2]["cost"], got[2]["duplicate"], got[2]["illegal"], got[2]["n_turns"]) == ("KDI", 7, 1, 1, 2)
    none = repair.digest(repair.repair(spark.createDataFrame([], SCHEMA)))
    assert none.count() == 0 and none.columns[:2] == ["conv_id", "gaps"]


def test_clashing_columns_and_long_texts(spark):
    rows = [(1, 0, "user", "x" * 2_000_000, "n", 7), (1, 1, "assistant", "Yes.", "m", 8)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, fault string, copies int").withColumn("part", repair.F.lit(3))
    assert [r.asDict() for r in repair.digest(repair.repair(df)).drop("conv_id").collect()] == [plain_repair([r[:4] for r in rows])]
    dropped = repair.damaged(df)
    assert dropped.columns == ["conv_id", "turn", "role", "text", "copies"] and {r["copies"] for r in dropped.collect()} <= {0, 1, 2}


def test_another_grammar(spark):
    tool = repair.RoleGrammar(steps=((0, "u", 1), (1, "t", 1), (1, "a", 0)), final=frozenset({0}), pairs=frozenset({"ua", "ut", "ta", "tt", "au"}))
    machine = repair.Machine(tool, repair.Edits(delete=1))
    rows = [(1, 0, "user", "a."), (1, 1, "tool", "b."), (1, 2, "tool", "c"), (1, 3, "assistant", "d."), (1, 4, "system", "e.")]
    row = repair.digest(repair.repair(spark.createDataFrame(rows, SCHEMA), machine)).first()
    assert (row["audit"], row["cost"], row["illegal"]) == ("KKDKD", 2, 1)


def test_edits_without_a_least_are_refused():
    with pytest.raises(ValueError):
        repair.Edits(insert=0)
