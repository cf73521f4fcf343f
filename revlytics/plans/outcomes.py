"""Findings against expectations with severities, results of cases and of whole runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlytics.operators import archive, matching, release, results
from revlytics.plans.registry import query, table

_SEVERITIES = ("low", "medium", "high", "critical")


def _severity(k) -> F.Column:
    return F.element_at(F.array(*map(F.lit, _SEVERITIES)), (k % 4 + 1).cast("int"))


def _consuming(spark, sf) -> tuple[DataFrame, DataFrame]:
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("k"), F.col("l_suppkey").alias("s"), F.format_string("f%d.py", F.col("l_partkey") % 2).alias("path")).distinct()
    found = li.where("s % 2 = 1").select("case_id", "path", "line", F.format_string("R%d", F.col("k") % 3).alias("rule_id"), _severity(F.col("s")).alias("severity"))
    truth = li.where("s % 2 = 0").select("case_id", (F.col("line") * 1_000_000_000 + F.col("k") * 10_000 + F.col("s")).alias("t"), "path", F.col("line").alias("start"), F.when(F.col("k") % 5 > 0, F.col("line") + F.col("k") % 4 - 1).alias("end"), F.when(F.col("k") % 3 == 1, F.format_string(" R%d", F.col("s") % 3)).alias("rule_id"), F.when(F.col("k") % 7 > 0, _severity(F.col("k"))).alias("min_severity"))
    return found, truth


@query("""with recursive l as (select distinct l_orderkey as case_id, l_linenumber::bigint as line, l_partkey as k, l_suppkey as s, 'f' || l_partkey % 2 || '.py' as path from lineitem),
p as (select case_id, path, line, 'R' || k % 3 as rule, max(s % 4 + 1) as rank from l where s % 2 = 1 group by all),
t as (select case_id, path, line * 1000000000 + k * 10000 + s as t, line as a, greatest(line, case when k % 5 > 0 then line + k % 4 - 1 else line end) as b, case when k % 3 = 1 then 'R' || s % 3 else '' end as rule, case when k % 7 > 0 then k % 4 + 1 else 1 end as least from l where s % 2 = 0),
e as (select t.case_id, t.path, t, p.line || '/' || p.rule as p, greatest(0, a - p.line, p.line - b) as d, p.rank, p.line, p.rule, least from p join t on t.case_id = p.case_id and t.path = p.path where greatest(0, a - p.line, p.line - b) <= 2 and (t.rule = '' or t.rule = p.rule)),
o as (select case_id, path, t, any_value(least) as least, list({'p': p, 'd': d, 'rank': rank} order by d, rank desc, line, rule) as opts, row_number() over (partition by case_id, path order by t) as rn from e group by case_id, path, t),
m as (select case_id, path, 0::bigint as rn, []::varchar[] as used, null::bigint as t, null::bigint as d, null::bigint as rank, 0::bigint as least from (select distinct case_id, path from o) union all
select case_id, path, rn, case when x is null then used else list_append(used, x.p) end, t, x.d, x.rank, least from (select m.case_id, m.path, o.rn, m.used, o.t, o.least, list_filter(o.opts, lambda y: not list_contains(m.used, y.p))[1] as x from m join o on o.case_id = m.case_id and o.path = m.path and o.rn = m.rn + 1))
select case_id, t, d::bigint as distance, rank >= least as severity_passed, least >= 3 as high from m where d is not null""")
def consumed_findings(spark, sf):
    """Expectations in their order, each with the nearest finding left of its path and rule."""
    return results.consumed(*_consuming(spark, sf))


def _results(spark, sf) -> DataFrame:
    """Places are unique on either side, so there is one maximum matching: a prediction and a truth on one line of one path."""
    li = table(spark, sf, "lineitem")
    side = lambda odd, name: li.where(F.col("l_suppkey") % 2 == odd).groupBy(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 2).alias("path"), F.col("l_linenumber").cast("long").alias("line")).agg(F.min("l_partkey").alias("k")).withColumn(name, F.col("line") * 2 + F.col("path"))
    found, truth = side(1, "p").withColumn("severity", _severity(F.col("k"))), side(0, "t").withColumns({"start": F.col("line"), "end": F.col("line"), "severity": F.when(F.col("k") % 2 == 0, F.upper(_severity(F.col("k")))).otherwise(_severity(F.col("k")))})
    matched = matching.match(matching.edges(found, truth, ["case_id", "path"], 0), ["case_id", "path"], matching.max_matching).select("case_id", "t", "p")
    check = lambda name, ok: F.struct(F.lit(name).alias("name"), ok.alias("passed"))
    key = F.col("case_id") + F.col("t")
    checks = F.filter(F.array(F.when(key % 3 > 0, check("risk-reproduction", key % 5 > 0)), F.when(key % 11 > 0, check("patch-generated", key % 7 > 0)), check("compile", key % 4 > 0)), lambda c: c.isNotNull())
    repairs = matched.select("case_id", "t", results.repair_tier(checks, key % 4 > 0).alias("tier"))
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 10 < 8, "validation").otherwise("holdout").alias("split"), (F.col("o_orderkey") % 13 == 0).alias("failed"))
    return results.case_results(cases, found, truth, matched, repairs)


_TIER = "case when k3 > 0 and k5 = 0 then 'unreproduced' when k11 = 0 or k7 = 0 then 'suggestion-only' when k4 > 0 then 'verified-draft' else 'blocked' end"
_RESULTS = f"""with l as (select l_orderkey as case_id, l_suppkey % 2 as odd, l_partkey % 2 as path, l_linenumber::bigint as line, min(l_partkey) as k from lineitem group by all),
f as (select * from l where odd = 1), t as (select * from l where odd = 0), w as (select case_id, count(*) as expected, count_if(k % 4 >= 2)::bigint as high_total from t group by all), g as (select case_id, count(*) as predicted from f group by all),
m as (select t.case_id, t.k as a, f.k as b, t.case_id + t.line * 2 + t.path as key from t join f on f.case_id = t.case_id and f.path = t.path and f.line = t.line),
h as (select case_id, count(*) as tp, count_if(a % 4 = b % 4)::bigint as severity_hits, count_if(a % 4 >= 2)::bigint as high_hits, {', '.join(f"count_if(tier = '{t}')::bigint as repair_{t.replace('-', '_')}" for t in results.REPAIR_TIERS)} from (select *, {_TIER} as tier from (select *, key % 3 as k3, key % 5 as k5, key % 11 as k11, key % 7 as k7, key % 4 as k4 from m)) group by all),
c as (select o_orderkey as case_id, case when o_orderkey % 10 < 8 then 'validation' else 'holdout' end as split, o_orderkey % 13 = 0 as failed, (o_orderkey % 13 <> 0)::bigint as live from orders),
r as (select c.case_id, split, coalesce(expected, 0) as expected, live * coalesce(predicted, 0) as predicted, live * coalesce(tp, 0) as tp, live * (coalesce(predicted, 0) - coalesce(tp, 0)) as fp, coalesce(expected, 0) - live * coalesce(tp, 0) as fn, live * coalesce(severity_hits, 0) as severity_hits,
 coalesce(high_total, 0) as high_total, live * coalesce(high_hits, 0) as high_hits, not failed and coalesce(expected, 0) = 0 and coalesce(predicted, 0) = 0 as clean_hit, not failed as execution_success, live * coalesce(tp, 0) as repair_attempted, live * coalesce(repair_verified_draft, 0) as repair_passed,
 {', '.join(f"live * coalesce(repair_{t.replace('-', '_')}, 0) as repair_{t.replace('-', '_')}" for t in results.REPAIR_TIERS)} from c left join w on w.case_id = c.case_id left join g on g.case_id = c.case_id left join h on h.case_id = c.case_id),
x as (select *, expected > 0 and tp = expected and repair_passed = expected as e2e_success from r)"""


@query(f"{_RESULTS} select * from x")
def full_case_results(spark, sf):
    """Every case's counts: findings, severities, repairs by tier, success end to end."""
    return _results(spark, sf)


def _rate(n: str, d: str) -> str:
    return f"round(({n})::double / nullif({d}, 0), 4)"


@query(f"""{_RESULTS}, s as (select split, count(*) as cases, count_if(expected > 0)::bigint as risk_cases, count_if(expected = 0)::bigint as clean_cases, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(severity_hits)::bigint as severity_hits, sum(high_total)::bigint as high_total, sum(high_hits)::bigint as high_hits,
sum(repair_attempted)::bigint as repair_attempted, sum(repair_passed)::bigint as repair_passed, {', '.join(f"sum(repair_{t.replace('-', '_')})::bigint as repair_{t.replace('-', '_')}" for t in results.REPAIR_TIERS)}, count_if(clean_hit)::bigint as clean_hits, count_if(execution_success)::bigint as execution_successes, count_if(e2e_success)::bigint as e2e_successes from x group by split),
q as (select *, {_rate('tp', 'tp + fp')} as precision, {_rate('tp', 'tp + fn')} as recall, {_rate('severity_hits', 'tp')} as severity_accuracy, {_rate('high_hits', 'high_total')} as high_risk_recall, {_rate('clean_hits', 'clean_cases')} as clean_accuracy, {_rate('execution_successes', 'cases')} as execution_success_rate,
{_rate('repair_passed', 'repair_attempted')} as safe_fix_rate, {_rate('repair_verified_draft', 'repair_attempted - repair_unreproduced')} as verified_draft_rate, {_rate('repair_blocked', 'repair_attempted - repair_unreproduced')} as blocked_rate, {_rate('repair_suggestion_only', 'repair_attempted - repair_unreproduced')} as suggestion_only_rate, {_rate('e2e_successes', 'risk_cases')} as e2e_security_fix_rate from s)
select *, case when precision + recall = 0 then 0.0 else round(2 * precision * recall / (precision + recall), 4) end::double as f1 from q""")
def full_run_metrics(spark, sf):
    """Totals and rates by split."""
    return results.run_metrics(_results(spark, sf), ["split"])


_SIDES = ("c", "b", "ch", "bh")


def _replays(spark, sf) -> DataFrame:
    """A pair of replays for each customer: orders are cases, of the candidate or the baseline, on validation or holdout."""
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    expected = F.when(k % 5 == 0, 0).otherwise(k % 3 + 1)
    ok = k % 31 > 0
    tp = F.when(ok, F.least(expected, k % 4)).otherwise(0)
    rows = o.select(
        F.col("o_custkey").alias("skill"), F.element_at(F.array(*map(F.lit, _SIDES)), (k % 4 + 1).cast("int")).alias("side"), expected.alias("expected"), tp.alias("tp"), F.when(ok, F.when(k % 6 == 0, 1).otherwise(0)).otherwise(0).alias("fp"), (expected - tp).alias("fn"),
        F.least(tp, k % 2 + 1).alias("severity_hits"), F.least(expected, k % 2).alias("high_total"), F.least(tp, k % 2).alias("high_hits"), ok.alias("ok"),
    )
    metrics = release.replay_metrics(rows, ["skill", "side"])
    every = F.struct(*(c for c in metrics.columns if c not in ("skill", "side")))
    sides = [F.max(F.when(F.col("side") == s, every)).alias(s) for s in _SIDES]
    return metrics.groupBy("skill").agg(*sides)


_SCORES = """k as (select o_custkey as skill, ['c', 'b', 'ch', 'bh'][o_orderkey % 4 + 1] as side, case when o_orderkey % 5 = 0 then 0 else o_orderkey % 3 + 1 end as e, o_orderkey as o, o_orderkey % 31 > 0 as ok from orders),
q as (select *, case when ok then least(e, o % 4) else 0 end as tp, case when ok and o % 6 = 0 then 1 else 0 end as fp from k),
s as (select skill, side, sum(tp) as tp, sum(fp) as fp, sum(e - tp) as fn, sum(least(tp, o % 2 + 1)) as sh, sum(least(e, o % 2)) as ht, sum(least(tp, o % 2)) as hh, sum(e) as e, count(*) as n, count(*) filter (where e > 0) as pos, count(*) filter (where e = 0) as cl, count(*) filter (where e = 0 and ok and tp + fp = 0) as clh, count(*) filter (where ok) as okn from q group by all),
x as (select *, 2.0 * tp / nullif(2 * tp + fp + fn, 0) as f1x, sh::double / nullif(tp, 0) as sax, clh::double / nullif(cl, 0) as cax from s),
m as (select *, round(coalesce((coalesce(case when e > 0 then f1x * 0.65::double end, 0) + coalesce(case when e > 0 then sax * 0.15::double end, 0) + coalesce(cax * 0.20::double, 0)) / nullif(case when e > 0 and f1x is not null then 0.65::double else 0 end + case when e > 0 and sax is not null then 0.15::double else 0 end + case when cax is not null then 0.20::double else 0 end, 0), 0) * (okn::double / n), 4) as score,
 round(tp::double / nullif(tp + fp, 0), 4) as pr, round(tp::double / nullif(tp + fn, 0), 4) as rc, round(hh::double / nullif(ht, 0), 4) as hr, round(sax, 4) as sa, round(cax, 4) as ca from x),
w as (select z.skill, c, b, ch, bh from (select distinct skill from m) z left join m c on c.skill = z.skill and c.side = 'c' left join m b on b.skill = z.skill and b.side = 'b' left join m ch on ch.skill = z.skill and ch.side = 'ch' left join m bh on bh.skill = z.skill and bh.side = 'bh')"""


def _falls(c: str, b: str) -> str:
    test = lambda n: f"({b}.{n} is not null and not coalesce({c}.{n} + 0.02::double >= {b}.{n}, false))"
    other = f"coalesce({b}.tp <> {c}.tp, false)"
    return (
        f"list_sort(list_filter([case when coalesce({b}.cl > 0, false) and {test('ca')} then 'clean_accuracy' end, case when {test('hr')} then 'high_severity_recall' end, case when {test('pr')} then 'precision' end, case when {test('rc')} then 'recall' end, case when {test('score')} then 'score' end, "
        f"case when coalesce({b}.pos > 0, false) and (({other} and not coalesce({c}.sh, 0) >= coalesce({b}.sh, 0)) or (not {other} and {test('sa')})) then 'severity_accuracy' end], lambda y: y is not null))"
    )


@query(f"""with {_SCORES}, d as (select skill, c.score as score, b.score as baseline, coalesce(c.n - c.okn, 0) + coalesce(b.n - b.okn, 0) + coalesce(ch.n - ch.okn, 0) + coalesce(bh.n - bh.okn, 0) as errors, coalesce(c.score >= b.score + 0.01::double, false) as better, {_falls('c', 'b')} as vf, {_falls('ch', 'bh')} as hf, coalesce(b.n >= 2, false) as ready, coalesce(bh.n >= 1, false) as hready from w),
r as (select *, case when skill % 9 = 0 then ['unsafe or incomplete prompt'] when not ready then ['too few validation cases'] when not hready then ['too few holdout cases'] else list_filter([case when errors > 0 then 'one or more evaluations failed' end, case when not better then 'score improvement was below the threshold' end,
 case when len(vf) > 0 then 'a protected validation metric regressed (' || array_to_string(vf, ', ') || ')' end, case when len(hf) > 0 then 'a protected holdout metric regressed (' || array_to_string(hf, ', ') || ')' end], lambda y: y is not null) end as why from d)
select skill, score, baseline, case when skill % 9 = 0 then 'rejected' when not ready or not hready then 'deferred' when len(why) > 0 then 'rejected' when skill % 2 = 0 then 'activated' else 'shadow_ready' end as decision, array_to_string(why, '; ') as reasons from r""")
def candidate_decisions(spark, sf):
    """What is decided on every customer's candidate, with all reasons."""
    enough = lambda side, n: F.coalesce(F.col(f"{side}.cases") >= n, F.lit(False))
    out = release.decided(_replays(spark, sf), F.col("skill") % 9 > 0, enough("b", 2), enough("bh", 1), F.col("skill") % 2 == 0, 0.01, 0.02)
    return out.select("skill", F.col("c.score").alias("score"), F.col("b.score").alias("baseline"), "decision", F.array_join("reasons", "; ").alias("reasons"))


def _archive(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Versions and scores of 60 skills; a ninth of them has no scores, a seventh nothing active."""
    k, skill = F.col("o_orderkey"), F.col("o_custkey") % 60
    o = table(spark, sf, "orders")
    versions = o.groupBy(skill.alias("skill"), (k % 8).alias("version")).agg(F.round(F.max(k % 1000) / 100, 2).alias("score"), F.min(k).alias("m"))
    versions = versions.select("skill", "version", "score", ((F.col("skill") % 7 > 0) & (F.col("version") % 3 == 0)).alias("active"), F.when(F.col("version") % 4 > 0, F.when(F.col("version") % 2 == 0, "rejected").otherwise("activated")).alias("decision"))
    scores = o.where((skill % 9 > 0) & (k % 8 != 5)).select(skill.alias("skill"), (k % 8).alias("version"), F.col("o_custkey").alias("case_id"), F.when(k % 10 > 0, k % 4).alias("score"))
    return versions, scores


_ARCHIVE = """v as (select o_custkey % 60 as skill, o_orderkey % 8 as version, round(max(o_orderkey % 1000) / 100.0, 2)::double as score from orders group by all), w as (select *, skill % 7 > 0 and version % 3 = 0 as active from v),
s as (select o_custkey % 60 as skill, o_orderkey % 8 as version, o_custkey as case_id, max(case when o_orderkey % 10 > 0 then o_orderkey % 4 end) as score from orders where (o_custkey % 60) % 9 > 0 and o_orderkey % 8 <> 5 group by all),
b as (select skill, case_id, max(score) as best from s where score is not null group by all), f as (select s.skill, s.version, count(*) as leads from s join b on b.skill = s.skill and b.case_id = s.case_id where s.score >= best group by all),
h as (select skill, max(version) filter (where active) as active, arg_max(version, score * 100000 + version) as best, list_sort(list(version)) as vs from w group by skill)"""


@query(f"""with {_ARCHIVE} select h.skill, count(*)::bigint as versions, (select count(distinct version) from s where s.skill = h.skill and score is not null)::bigint as evaluated, (select count(*) from f where f.skill = h.skill)::bigint as frontier_size, h.active as active_version, h.best as best_version,
concat_ws(',', 'activated=' || nullif(count(*) filter (where version % 4 in (1, 3)), 0), 'rejected=' || nullif(count(*) filter (where version % 4 = 2), 0), 'unknown=' || nullif(count(*) filter (where version % 4 = 0), 0)) as decisions from h join w on w.skill = h.skill group by h.skill, h.active, h.best""")
def archive_summary(spark, sf):
    """What each skill's archive holds."""
    out = archive.summary(*_archive(spark, sf), ["skill"])
    return out.withColumn("decisions", F.array_join(F.transform(F.map_entries("decisions"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


_UNIT = "('0x' || substr(sha256({}), 1, 16))::ubigint::double / 18446744073709551616.0::double"


@query(f"""with {_ARCHIVE}, a as (select skill, unnest(['active', 'best', 'pareto', 'epsilon_greedy']) as strategy from h), u as (select *, skill || '/' || strategy as seed, {_UNIT.format("skill || '/' || strategy")} as u, {_UNIT.format("skill || '/' || strategy || ':explore'")} as x from a),
l as (select skill, version, sum(leads) over (partition by skill order by version) as upto, sum(leads) over (partition by skill) as total from f),
p as (select u.skill, u.strategy, min(l.version) filter (where u.u * l.total < l.upto) as version from u join l on l.skill = u.skill group by all)
select u.skill, u.strategy, case u.strategy when 'active' then coalesce(h.active, h.best) when 'best' then h.best when 'pareto' then coalesce(p.version, h.active, h.best) else case when u.u < 0.4 then h.vs[(floor(u.x * len(h.vs)) % len(h.vs))::int + 1] else h.best end end as version,
case u.strategy when 'active' then case when h.active is null then 'best' else 'active' end when 'best' then 'best' when 'pareto' then case when p.version is not null then 'pareto' when h.active is null then 'best' else 'active' end else case when u.u < 0.4 then 'explore' else 'exploit' end end as resolved,
case when u.strategy = 'active' and h.active is null then 'active' when u.strategy = 'pareto' and p.version is null then 'pareto' else '' end as fell_back_from from u join h on h.skill = u.skill left join p on p.skill = u.skill and p.strategy = u.strategy""")
def chosen_parents(spark, sf):
    """The parent of each skill's next round by each strategy, and what it fell back from."""
    versions, scores = _archive(spark, sf)
    asked = versions.select("skill").distinct().select("skill", F.explode(F.array(*map(F.lit, archive.STRATEGIES))).alias("strategy"), F.lit(0.4).alias("epsilon"))
    asked = asked.withColumn("seed", F.concat(F.col("skill").cast("string"), F.lit("/"), F.col("strategy")))
    return archive.parents(asked, versions, scores, ["skill"]).select("skill", "strategy", "version", "resolved", "fell_back_from")
