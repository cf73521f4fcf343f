"""Prompts read, compared, changed and written: hand-made blocks, random logs against a loop, a round trip."""

import random
import re

from pyspark.sql import functions as F

from revlytics.operators import prompts

H = prompts.HEADER
LOG = "case_id long, at long, op string, rule_id string, text string, run_id string, gates array<string>, reason string"
ENTRY = "case_id long, rule_id string, text string, run_id string, gates array<string>"


def test_blocks_are_read(spark):
    texts = {
        1: f"Body\n- layout\n\n{H}\n- a [src:r1] [gates:x,y]\n\n-  b [focus-rule:AB]. [src:r2]\nend\n- not this\n  {H}  \n\t- c\n-\n- after an empty dash", 2: None, 3: "", 4: f"{H}\n- [src:only]\n- x", 5: f"no block {H}\n- x", 6: f"{H}\r\n- é\r\n{H}\r\n- z",
    }
    df = spark.createDataFrame(list(texts.items()), "case_id long, p string")
    got = {r["case_id"]: (r["rule_ids"], r["constraints"]) for r in prompts.inventory(df, "case_id", "p").collect()}
    assert got == {1: (["AB"], ["a", "b [focus-rule:AB].", "c"]), 2: ([], []), 3: ([], []), 4: ([], ["", "x"]), 5: ([], []), 6: ([], ["é", "z"])}


def test_retention_has_three_answers(spark):
    p = lambda *rules: "Do.\n" + H + "".join(f"\n- {r}" for r in rules)
    rows = [(1, p("free"), p()), (2, p("a [focus-rule:R1]."), p("b [focus-rule:R1].")), (3, p("a [focus-rule:R1].", "c [focus-rule:R2]", "d", "d"), p("d2")), (4, p("a [focus-rule:R1]. [src:1]"), p("a [focus-rule:R1]. [src:2]", "n [focus-rule:R9]")), (5, None, None), (6, p("x [focus-rule:OK]"), "")]
    df = spark.createDataFrame(rows, "case_id long, b string, c string")
    got = {r["case_id"]: r for r in prompts.retention(df, "case_id", "b", "c", F.array(F.lit("OK"), F.lit("R2"))).collect()}
    assert {k: r["passed"] for k, r in got.items()} == {1: None, 2: True, 3: False, 4: True, 5: None, 6: True}
    assert got[2]["dropped_constraints"] == ["a [focus-rule:R1]."] and got[4]["dropped_constraints"] == [] and got[4]["added_rule_ids"] == ["R9"]
    assert (got[3]["undeclared"], got[3]["declared"], got[3]["dropped_constraints"]) == (["R1"], ["R2"], ["a [focus-rule:R1].", "c [focus-rule:R2]", "d", "d"])


def test_written_prompts_are_read_back(spark):
    entries = spark.createDataFrame([(1, "R2", "second.", "r", ["g", "h"]), (1, "R1", "first [focus-rule:R1] inside", "", []), (2, "R3", "x", "", None)], ENTRY)
    bodies = spark.createDataFrame([(1, "Body  \n\n", [" loose. ", "", "two"]), (2, None, None), (3, "only\n", [])], "case_id long, body string, unstructured array<string>")
    out = prompts.composed(bodies, entries, "case_id")
    got = {r["case_id"]: r["prompt"] for r in out.collect()}
    assert got == {1: f"Body\n\n{H}\n- loose.\n- two\n- first [focus-rule:R1] inside\n- second [focus-rule:R2]. [src:r] [gates:g,h]", 2: f"\n\n{H}\n- x [focus-rule:R3].", 3: "only"}
    marked, rest = prompts.entries_of(out, "case_id", "prompt")
    assert sorted(tuple(r)[:3] for r in marked.collect()) == [(1, "R1", "first [focus-rule:R1] inside"), (1, "R2", "second [focus-rule:R2]."), (2, "R3", "x [focus-rule:R3].")]
    assert {r["case_id"]: (r["body"], r["unstructured"]) for r in rest.collect()} == {1: ("Body", ["loose.", "two"]), 2: ("", []), 3: ("only", [])}


def sequential(entries, log):
    """One case: (rules after, outcomes by at)."""
    clean = lambda t: re.sub(r"\s*\[(?:src|gates):[^\]]*\]", "", t or "").strip()
    seen, bad = set(), {}
    for at, op, rule, text, _, _, reason in log:
        r = (rule or "").strip()
        wrong = [w for w, is_ in (("unknown operation", op not in prompts.OPERATIONS), ("not a rule id", not re.fullmatch("[A-Z][A-Z0-9_-]{1,79}", r)), ("rule more than once", r in seen)) if is_]
        wrong += ["no text"] * (op in ("add", "replace") and not clean(text)) + ["no reason"] * (op == "drop" and not (reason or "").strip())
        if re.fullmatch("[A-Z][A-Z0-9_-]{1,79}", r):
            seen.add(r)
        bad[at] = wrong
    if any(bad.values()):
        return entries, {at: ("problem" if w else "voided", w) for at, w in bad.items()}
    rules, out = {k: dict(v) for k, v in entries.items()}, {}
    for at, op, rule, text, run, gates, _ in log:
        r = rule.strip()
        if (r in rules) is (op == "add"):
            out[at] = ("rejected", [])
            continue
        out[at] = ("applied", [])
        if op == "drop":
            del rules[r]
        else:
            old = rules.get(r, {"run": "", "gates": []})
            rules[r] = {"text": clean(text), "run": run or old["run"], "gates": sorted(gates or []) or old["gates"]}
    return rules, out


def test_logs_are_transactions(spark):
    rng = random.Random(3)
    entries, log, want_rules, want_out = [], [], {}, {}
    for c in range(150):
        held = {f"R{k}": {"text": f"t{k}", "run": rng.choice(["", "r0"]), "gates": rng.choice([[], ["g"]])} for k in rng.sample(range(8), 4)}
        entries += [(c, k, v["text"], v["run"], v["gates"]) for k, v in held.items()]
        rows = []
        for at in range(rng.randrange(5)):
            odd = rng.random() < 0.05
            rows.append((at, "rename" if odd and rng.random() < 0.3 else rng.choice(prompts.OPERATIONS), rng.choice([None, "r1", "R", "R 1"]) if odd else f" R{rng.choice(range(at * 3, at * 3 + 3)) if rng.random() < 0.9 else 0} ", rng.choice([None, " [src:q]"]) if rng.random() < 0.03 else f"new {at} [gates:a]", rng.choice([None, "", "r9"]), rng.choice([None, [], ["b", "a"]]), rng.choice([None, ""]) if rng.random() < 0.05 else "why"))
        log += [(c, *r) for r in rows]
        rules, out = sequential(held, rows)
        want_rules |= {(c, k): (v["text"], v["run"], v["gates"]) for k, v in rules.items()}
        want_out |= {(c, at): x for at, x in out.items()}
    after, outcomes = prompts.apply_log(spark.createDataFrame(entries, ENTRY), spark.createDataFrame(log, LOG), "case_id")
    assert {(r["case_id"], r["rule_id"]): (r["text"], r["run_id"], r["gates"]) for r in after.collect()} == want_rules
    assert {(r["case_id"], r["at"]): (r["outcome"], r["problems"]) for r in outcomes.collect()} == want_out
    assert {o for o, _ in want_out.values()} == {"applied", "rejected", "problem", "voided"}
    empty = spark.createDataFrame([], LOG)
    assert prompts.apply_log(spark.createDataFrame(entries, ENTRY), empty, "case_id")[0].count() == len(entries)
