"""Parents and summaries against plain Python."""

import hashlib
import random

import pytest

from revlytics.operators import archive


def unit(seed):
    return int.from_bytes(hashlib.sha256(seed.encode()).digest()[:8], "big") / float(1 << 64)


def test_parents_are_those_of_plain_python(spark):
    rng = random.Random(3)
    versions, scores, asked, want, held = [], [], [], {}, {}
    for k in range(40):
        own = sorted(rng.sample(range(1, 30), rng.randrange(0, 6)))
        active = [v for v in own if rng.random() < 0.3]
        score = {v: rng.choice([0.1, 0.5, 0.5, 0.9]) for v in own}
        cases = {(v, c): rng.choice([None, 0.0, 0.5, 1.0]) for v in own for c in range(4) if rng.random() < 0.5}
        versions += [(k, v, score[v], v in active, rng.choice([None, "rejected"])) for v in own]
        scores += [(k, v, c, s) for (v, c), s in cases.items()]
        best = {c: max(s for (_, d), s in cases.items() if d == c and s is not None) for c in {c for (_, c), s in cases.items() if s is not None}}
        leads = {v: n for v in own if (n := sum(1 for (w, c), s in cases.items() if w == v and s is not None and s >= best[c]))}
        top = max(own, key=lambda v: (score[v], v), default=None)
        now = max(active, default=None)
        held[k] = (len(own), len({v for (v, _), s in cases.items() if s is not None}), len(leads), now, top)
        for s in archive.STRATEGIES:
            seed, epsilon = f"{k}{s}", rng.choice([0.0, 0.5, 1.0])
            asked.append((k, s, seed, epsilon))
            if not own:
                want[k, s] = (None, None, None)
            elif s == "best":
                want[k, s] = (top, "best", "")
            elif s == "active" or (s == "pareto" and not leads):
                want[k, s] = (now if now is not None else top, "active" if now is not None else "best", "pareto" if s == "pareto" else "" if now is not None else "active")
            elif s == "pareto":
                at, upto = unit(seed) * sum(leads.values()), 0
                for v in sorted(leads):
                    upto += leads[v]
                    if at < upto:
                        break
                want[k, s] = (v, "pareto", "")
            else:
                want[k, s] = (own[int(unit(seed + ":explore") * len(own)) % len(own)], "explore", "") if unit(seed) < epsilon else (top, "exploit", "")
    v = spark.createDataFrame(versions, "k int, version long, score double, active boolean, decision string")
    s = spark.createDataFrame(scores, "k int, version long, case_id int, score double")
    a = spark.createDataFrame(asked, "k int, strategy string, seed string, epsilon double")
    got = {(r["k"], r["strategy"]): (r["version"], r["resolved"], r["fell_back_from"]) for r in archive.parents(a, v, s, ["k"]).collect()}
    assert got == want and {x[1] for x in want.values()} == {None, "active", "best", "pareto", "explore", "exploit"}
    total = {r["k"]: (r["versions"], r["evaluated"], r["frontier_size"], r["active_version"], r["best_version"]) for r in archive.summary(v, s, ["k"]).collect()}
    assert total == {k: x for k, x in held.items() if x[0]}
    with pytest.raises(Exception, match="no such strategy: odd"):
        archive.parents(spark.createDataFrame([(1, "odd", "", 0.1)], a.schema), v, s, ["k"]).collect()
