"""Best covering rows against counting every pair."""

import random
import re

from revlytics.operators import recall


def test_best_rows_are_those_of_all_pairs(spark, monkeypatch):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["the"] * 30 + ["É.x", "a", "UP"]
    text = lambda n: rng.choice([None, ""] + [" ".join(rng.choices(words, k=rng.randrange(n))) for _ in range(30)])
    rows, asked = [(i, text(25)) for i in range(400)] + [(None, "w1 w2")], [(f"q{i}", text(9)) for i in range(50)] + [(None, "w1")]
    tokens = lambda t: set(re.findall(recall.TOKEN, (t or "").lower()))
    want = set()
    for q, t in asked:
        best = sorted((-len(tokens(t) & tokens(x)), i) for i, x in rows if i is not None and tokens(t) & tokens(x))[:3] if q else []
        want |= {(q, i, -n, len(tokens(t))) for n, i in best}
    r, a = spark.createDataFrame(rows, "id long, text string").repartition(5), spark.createDataFrame(asked, "id string, text string")
    assert {tuple(x) for x in recall.best_covering(r, a, 3).collect()} == want
    monkeypatch.setattr(recall, "BLOCK", 7)
    assert {tuple(x) for x in recall.best_covering(r, a, 3).collect()} == want
    assert recall.best_covering(r, a.where("false"), 3).collect() == recall.best_covering(r.where("false"), a, 3).collect() == []
