"""Collecting in parallel against one repository after another."""

import random

import pytest

from revlytics.operators.collecting import collected

PULL = "repo string, page int, place int, number long, fix_screen string, fix_reason string, fix_print string, clean_screen string, clean_reason string, clean_print string"


def sequential(pulls, plan, requests, target, clean_target):
    """(repo, page, place, number) -> fate, in the plan's order; the requests left decide when everything ends."""
    out, seen, left, fixes, cleans, over = {}, set(), requests, 0, 0, False
    for repo, _, quota, clean_quota, max_pages in sorted(plan, key=lambda p: p[1]):
        mine = sorted(p for p in pulls if p[0] == repo)
        got = {"fix": 0, "clean": 0}
        numbers, stop = set(), over or (target is not None and fixes >= target and cleans >= clean_target and out != {})
        pages = sorted({p[1] for p in mine})
        for p in mine:
            out[p[:4]] = "not-reached" if not over else "out-of-requests"
        for page in [*range(1, max(pages, default=0) + 2)]:
            if stop or page > max_pages or (got["fix"] >= quota and got["clean"] >= clean_quota):
                break
            if left is not None and left < 1:
                over = stop = True
                break
            left = None if left is None else left - 1
            for p in [x for x in mine if x[1] == page]:
                if got["fix"] >= quota and got["clean"] >= clean_quota:
                    break
                if p[3] in numbers:
                    out[p[:4]] = "taken-before"
                    continue
                kind = "fix" if got["fix"] < quota else "clean"
                early, late, print_ = p[4:7] if kind == "fix" else p[7:10]
                if early:
                    out[p[:4]] = early
                    continue
                if left is not None and left < 1:
                    over = stop = True
                    break
                left = None if left is None else left - 1
                if late:
                    out[p[:4]] = late
                elif print_ in seen:
                    out[p[:4]] = "duplicate-diff"
                else:
                    seen.add(print_)
                    numbers.add(p[3])
                    got[kind] += 1
                    out[p[:4]] = "accepted"
        fixes, cleans = fixes + got["fix"], cleans + got["clean"]
    return out


@pytest.mark.parametrize("seed,requests,target", [(1, None, None), (2, 60, None), (3, 25, 6), (4, None, 5), (5, 1, None)])
def test_parallel_is_sequential(spark, tmp_path, seed, requests, target):
    rng = random.Random(seed)
    plan = [(f"r{i}", i, rng.randrange(4), rng.randrange(3), rng.randrange(1, 4)) for i in range(8)]
    pulls, number = [], 0
    for repo, *_ in plan:
        for page in range(1, rng.randrange(2, 5)):
            for place in range(rng.randrange(1, 7)):
                number += 1
                pick = lambda: rng.choice([None, None, None, "title"])
                pulls.append((repo, page, place, rng.choice([number, number, number - 1]), pick(), rng.choice([None, None, "shape"]), f"d{rng.randrange(14)}", pick(), rng.choice([None, "wait"]), f"d{rng.randrange(14)}"))
    pulls = list({p[:4]: p for p in pulls}.values())

    def written(df, name):
        df.write.mode("overwrite").parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    got = collected(spark.createDataFrame(pulls, PULL), spark.createDataFrame(plan, "repo string, seq int, quota int, clean_quota int, max_pages int"), written, requests, target, 2 if target else None).collect()
    want = sequential(pulls, plan, requests, target, 2 if target else None)
    fold = lambda f: "never" if f in ("not-reached", "out-of-requests") else f  # noqa: E731  which of the two ends a change is told by the sums
    assert {(r["repo"], r["page"], r["place"], r["number"]): fold(r["fate"]) for r in got if r["number"] is not None} == {k: fold(v) for k, v in want.items()}
    if requests is not None:
        assert sum(r["cost"] for r in got) <= requests
