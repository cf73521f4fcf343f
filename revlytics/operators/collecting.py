"""Cases collected from listed changes, repository by repository, until quotas, totals or requests are used up.

What becomes of a change depends on those before it: fixes are wanted until the repository's quota of them is full, then clean changes; a diff that was
taken before, in this repository or an earlier one, is a duplicate; nothing is asked for once the requests are spent. Repositories are read in parallel, each as a stream, first as if it
were alone. Then each is told which diffs earlier ones took, and read again, until nothing changes: the first is right from the start, each next one once those before it are,
so the result is that of reading one after another. Totals and requests cut the sequence afterwards, since no decision looks ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlytics.operators.folds import streamed

FATE = "seq int, page int, place int, number long, kind string, fate string, print string, cost int"


class _Repository:
    """One repository: its rows by page and place."""

    def __init__(self):
        self.accepted, self.clean, self.page, self.prints, self.numbers, self.last = 0, 0, None, set(), set(), None

    def full(self, r: dict) -> bool:
        return self.accepted >= r["quota"] and self.clean >= r["clean_quota"]

    def row(self, r: dict) -> list[tuple]:
        self.last = r
        out = lambda kind, fate, print_, cost: [(r["seq"], r["page"], r["place"], r["number"], kind, fate, print_, cost)]
        if r["page"] > r["max_pages"] or self.full(r):
            return out(None, "not-reached", None, 0)
        cost = int(r["page"] != self.page)  # a page is listed with its first change
        self.page = r["page"]
        if r["number"] in self.numbers:
            return out(None, "taken-before", None, cost)
        kind = "fix" if self.accepted < r["quota"] else "clean"
        early, late, print_, taken = (r[f"{kind}_{c}"] for c in ("screen", "reason", "print", "taken"))
        if early is not None:
            return out(kind, early, None, cost)
        cost += 1
        if late is not None:
            return out(kind, late, None, cost)
        if taken or print_ in self.prints:
            return out(kind, "duplicate-diff", print_, cost)
        self.prints.add(print_)
        self.numbers.add(r["number"])
        if kind == "fix":
            self.accepted += 1
        else:
            self.clean += 1
        return out(kind, "accepted", print_, cost)

    def end(self) -> list[tuple]:
        # A repository that isn't full is asked for one more page, which is empty.
        r = self.last
        if self.full(r) or self.page is None or self.page >= r["max_pages"] or r["page"] > self.page:
            return []
        return [(r["seq"], self.page + 1, 0, None, None, "empty-page", None, 1)]


def collected(pulls: DataFrame, plan: DataFrame, written, requests: int | None = None, target: int | None = None, clean_target: int | None = None, most_rounds: int = 100) -> DataFrame:
    """repo and FATE of every listed change: accepted, a reason, duplicate-diff, taken-before, not-reached or out-of-requests; and a row for each empty page that was asked for.

    pulls: repo, page, place, number, and for fix_ and clean_: screen (why the title is refused: costs nothing), reason (why the diff is: costs a request), print (the diff's fingerprint). plan: repo, seq (order),
    quota, clean_quota, max_pages. A page costs a request, too. written(df, name) stores a frame and reads it back. Repositories after the one with which both targets are reached aren't read.
    """
    rows = pulls.join(plan, "repo").withColumns({"fix_taken": F.lit(False), "clean_taken": F.lit(False)})
    order = [F.col("page"), F.col("place"), F.col("number")]
    done = written(streamed(rows, "repo", order, _Repository, FATE), "round-0")
    for n in range(1, most_rounds + 1):
        first = done.where("fate = 'accepted'").groupBy("print").agg(F.min("seq").alias("first"))
        told = rows
        for kind in ("fix", "clean"):
            other = first.select(F.col("print").alias(f"{kind}_print"), F.col("first").alias(f"_{kind}"))
            told = told.join(other, f"{kind}_print", "left").withColumn(f"{kind}_taken", F.coalesce(F.col(f"_{kind}") < F.col("seq"), F.lit(False))).drop(f"_{kind}")
        new = written(streamed(told, "repo", order, _Repository, FATE), f"round-{n}")
        key = ["seq", "page", "place", "number"]
        changed = new.where("fate = 'accepted'").select(*key, "print").exceptAll(done.where("fate = 'accepted'").select(*key, "print"))
        # As many are accepted, so that nothing is lacking if nothing is new.
        same = changed.isEmpty() and done.where("fate = 'accepted'").count() == new.where("fate = 'accepted'").count()
        done = new
        if same:
            break
    else:
        raise ValueError(f"repositories still change each other after {most_rounds} rounds")
    return _cut(done, requests, target, clean_target)


def _cut(done: DataFrame, requests: int | None, target: int | None, clean_target: int | None) -> DataFrame:
    """Fates after targets and requests have ended the run; sums by repository first, then within one."""
    taken = lambda kind: F.count_if((F.col("fate") == "accepted") & (F.col("kind") == kind))
    by = done.groupBy("seq").agg(F.sum("cost").alias("spent"), taken("fix").alias("fix"), taken("clean").alias("clean"))
    before = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a repository
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    starts = by.select("seq", total("spent").alias("_spent"), total("fix").alias("_fix"), total("clean").alias("_clean"))
    rows = done.join(starts, "seq")
    ended: Column = F.lit(False)
    if target is not None:
        ended = (F.col("_fix") >= target) & (F.col("_clean") >= (clean_target or 0)) & (F.col("seq") > 0)
    upto = F.col("_spent") + F.sum("cost").over(Window.partitionBy("seq").orderBy("page", "place", F.col("number").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_upto", upto)
    over = F.lit(False) if requests is None else F.col("_upto") > requests
    fate = F.when(ended, "not-reached").when(over & (F.col("fate") != "not-reached"), "out-of-requests").otherwise(F.col("fate"))
    out = rows.withColumn("fate", fate)
    gone = F.col("fate").isin("not-reached", "out-of-requests")
    out = out.where(~((F.col("number").isNull()) & gone))
    return out.select("repo", "seq", "page", "place", "number", F.when(~gone, F.col("kind")).alias("kind"), "fate", F.when(~gone, F.col("print")).alias("print"), F.when(gone, 0).otherwise(F.col("cost")).alias("cost"))
