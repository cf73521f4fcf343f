"""Stateful streams against plain loops, with a restart from the checkpoint, and by their timers."""

import random
import time

import pytest
from pyspark.sql import Row

from revlytics.streaming.stateful import Rollout, deliveries, rollouts, state_store

EVENT = "key string, event_id long, kind string, candidate long, failed boolean, disagreement double"


def loop(events, least, most_errors, most_disagreement, promotes):
    """key -> final state and the changes on the way."""
    out = {}
    for key, _, kind, candidate, failed, disagreement in sorted(events, key=lambda e: e[1]):
        s = out.get(key)
        if kind == "stage":
            if s is None or s["status"] != "running":
                out[key] = {"status": "running", "candidate": candidate, "stable": s["stable"] if s else None, "n": 0, "e": 0, "s": 0, "d": 0, "log": [*(s["log"] if s else []), "staged"]}
            else:
                s["log"].append("already running" if s["candidate"] == candidate else "refused")
        elif kind == "promote":
            if s and s["status"] == "running" and s["candidate"] == candidate:
                s["status"], s["stable"] = "promoted", candidate
                s["log"].append("promoted")
            elif s:
                s["log"].append("refused")
        elif s and kind == "result":
            s["n"] += 1
            s["e"] += bool(failed)
            if s["status"] == "running" and s["n"] >= least and s["e"] > most_errors * s["n"]:
                s["status"] = "rolled_back"
                s["log"].append("rolled_back")
        elif s:
            s["s"] += 1
            s["d"] += (disagreement or 0) > 0
            if s["status"] == "running" and promotes and s["s"] >= least and s["d"] <= most_disagreement * s["s"] and s["e"] <= most_errors * s["n"] and not failed:
                s["status"], s["stable"] = "promoted", s["candidate"]
                s["log"].append("promoted")
    return out


@pytest.mark.parametrize("promotes", [True, False])
def test_rollouts_survive_a_restart(spark, tmp_path, promotes):
    rng = random.Random(6)
    keys = [f"t{i}" for i in range(12)]
    events = [(rng.choice(keys), i, rng.choices(["stage", "result", "shadow", "promote"], [2, 24, 24, 1])[0], rng.randrange(3), rng.random() < (0.1 + 0.02 * (i % 12)), rng.choice([None, 0.0, 0.0, 0.5])) for i in range(1500)]
    rules = Rollout(20, 0.25, 0.5, promotes)
    with state_store(spark):
        for part in range(3):  # each time a new query from the same checkpoint
            spark.createDataFrame(events[part * 500 : part * 500 + 500], EVENT).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1 if part == 9 else 1000).parquet(str(tmp_path / "in"))
            q = rollouts(stream, rules).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start(str(tmp_path / "out"))
            q.awaitTermination(120)
    rows = sorted(spark.read.parquet(str(tmp_path / "out")).collect(), key=lambda r: (r["event_id"], r["what"] == "batch"))
    got = {}
    for r in rows:
        x = got.setdefault(r["key"], {"log": []})
        x["log"] += [r["what"]] if r["what"] != "batch" else []
        x |= {"status": r["status"], "candidate": r["candidate"], "stable": r["stable"], "n": r["samples"], "e": r["errors"], "s": r["shadow_samples"], "d": r["disagreements"]}
    want = loop(events, 20, 0.25, 0.5, promotes)
    assert got == want
    assert {x for v in want.values() for x in v["log"]} >= {"staged", "refused", "already running", "rolled_back"}


def test_deliveries_are_retried_by_timers(spark, tmp_path):
    schema = "message_id string, payload string"
    spark.createDataFrame([("a", "good"), ("b", "third"), ("c", "never"), ("d", "bad"), ("a", "good")], schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def handler(payload, attempt):
        return "ok" if payload == "good" or (payload == "third" and attempt == 3) else "permanent" if payload == "never" else "error"

    def start():
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        return deliveries(stream, handler, 3, 100).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(processingTime="200 milliseconds").start(str(tmp_path / "out"))

    def rows():
        try:
            return sorted(tuple(r) for r in spark.read.schema("message_id string, attempt int, status string, wait_s int, payload string").parquet(str(tmp_path / "out")).collect())
        except Exception:  # nothing written yet
            return []

    with state_store(spark):
        for enough in (4, 8):  # stopped after the first attempts, and started again from the checkpoint
            q, end = start(), time.time() + 60
            while len(rows()) < enough and time.time() < end and q.isActive:
                time.sleep(0.3)
            if enough == 4:
                spark.createDataFrame([("a", "bad"), ("d", "good")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            q.stop()
    assert rows() == [("a", 1, "done", None, None), ("b", 1, "retry", 1, None), ("b", 2, "retry", 2, None), ("b", 3, "done", None, None), ("c", 1, "dead", None, "never"), ("d", 1, "retry", 1, None), ("d", 2, "retry", 2, None), ("d", 3, "dead", None, "bad")]


def test_a_step_keeps_what_ended():
    rules = Rollout(1, 0.0, 0.0, True)
    e = lambda kind, candidate=1, failed=False, disagreement=None: Row(event_id=1, kind=kind, candidate=candidate, failed=failed, disagreement=disagreement)
    assert rules.step(None, e("result")) == (None, "ignored")
    state, _ = rules.step(None, e("stage"))
    back, what = rules.step(state, e("result", failed=True))
    assert what == "rolled_back" and rules.step(back, e("shadow"))[0][0] == "rolled_back"
    again, what = rules.step(back, e("stage", 2))
    assert what == "staged" and again == ("running", 2, None, 0, 0, 0, 0)
    assert rules.step(None, e("promote")) == (None, "ignored") and rules.step(again, e("promote", 1)) == (again, "refused") and rules.step(again, e("promote", 2))[0][:3] == ("promoted", 2, 2)
    assert rules.step(again, e("shadow", failed=True))[1] == "counted" and rules.step(again, e("shadow"))[0][:3] == ("promoted", 2, 2)
