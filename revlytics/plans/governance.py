"""Gates, labels, outcomes and releases: what decides whether a finding, a label or a candidate is accepted."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlytics.functions import review as R
from revlytics.functions.metrics import non_regressing, not_worse, ratio, wilson
from revlytics.operators import diffs
from revlytics.plans.corpus import _PATH, _diffs
from revlytics.plans.evaluation import _wilson_sql
from revlytics.plans.registry import query, table

_RAW = "case p_partkey % 4 when 0 then 'a/src\\' || p_type when 1 then './b/' || p_brand when 2 then 'b/a/' || p_type else p_brand end"
_SEV = "case l_linenumber % 4 when 0 then 'critical' when 1 then 'low' when 2 then 'high' else 'medium' end"


def _sev():
    return F.element_at(F.array(*map(F.lit, ("critical", "low", "high", "medium"))), (F.col("l_linenumber") % 4 + 1).cast("int"))


@query(f"""select p_partkey, regexp_replace(replace(r, '\\', '/'), '^[ab]/', '') as for_match, regexp_replace(regexp_replace(regexp_replace(replace(r, '\\', '/'), '^[.]/', ''), '^a/', ''), '^b/', '') as for_tools from (select p_partkey, {_RAW} as r from part)""")
def normalised_paths(spark, sf):
    k, kind, brand = F.col("p_partkey") % 4, F.col("p_type"), F.col("p_brand")
    raw = F.when(k == 0, F.concat(F.lit("a/src\\"), kind)).when(k == 1, F.concat(F.lit("./b/"), brand)).when(k == 2, F.concat(F.lit("b/a/"), kind)).otherwise(brand)
    return table(spark, sf, "part").select("p_partkey", R.match_path(raw).alias("for_match"), R.tool_path(raw).alias("for_tools"))


@query(f"""select p_partkey as case_id, sha1('--- a/' || f || chr(10) || '+++ b/' || f || chr(10) || '-old ' || p_name || chr(10) || '+new ' || p_name || chr(10) || '+type ' || p_type || chr(10) || '+size ' || p_size) as fingerprint from (select *, {_PATH} as f from part)""")
def change_fingerprints(spark, sf):
    return _diffs(spark, sf).select("case_id", diffs.change_fingerprint(F.col("diff")).alias("fingerprint"))


@query("""select f as kind, l_suppkey as path, l_partkey as rule, max(sev)::bigint as severity from (select case when l_returnflag = 'A' then 'a' else 'b' end as f, l_suppkey, l_partkey, case l_linenumber % 4 when 0 then 4 when 1 then 1 when 2 then 3 else 2 end as sev from lineitem) group by all""")
def highest_severity(spark, sf):
    """Of findings of one rule at one place the highest severity stays; partial maxima, no window."""
    kind = F.when(F.col("l_returnflag") == "A", "a").otherwise("b").alias("kind")
    return table(spark, sf, "lineitem").groupBy(kind, F.col("l_suppkey").alias("path"), F.col("l_partkey").alias("rule")).agg(F.max(R.severity_rank(_sev())).alias("severity"))


@query(f"""select l_orderkey as task_id, case when max(rank) >= 3 then 'high' when max(rank) = 2 then 'medium' else 'low' end as risk from (select l_orderkey, case {_SEV} when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end as rank from lineitem) group by all""")
def review_risk(spark, sf):
    top = F.max(R.severity_rank(_sev()))
    risk = F.when(top >= 3, "high").when(top == 2, "medium").otherwise("low")
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(risk.alias("risk"))


@query("""select list_aggregate(r, 'string_agg', ',') as reasons, count(*)::bigint as findings from (select list_filter([
case when l_linenumber % 5 = 0 or l_shipmode = '' then 'format' end, case when not (l_partkey % 3 = 0 and l_linenumber % 5 <> 0) and l_suppkey % 3 = 0 and l_orderkey % 7 <> 0 then 'evidence' end,
case when sev in ('critical', 'high') and not l_suppkey % 3 = 1 and l_orderkey % 7 <> 0 then 'strong-evidence' end, case when l_discount * 10 < 0.55 then 'confidence' end,
case when sev in ('critical', 'high') and l_tax = 0 then 'release' end], lambda x: x is not null) as r from (select *, 'r' as l_shipmode, """ + _SEV + """ as sev from lineitem)) group by all""")
def gate_reasons(spark, sf):
    """The finding gate's checks, all reasons kept; null reasons: accepted."""
    key = F.col
    found = {
        "line": F.when(key("l_linenumber") % 5 != 0, F.lit(" x = load(p) ")), "rule_id": F.lit("r"), "title": F.lit("t"), "explanation": F.lit("e"),
        "evidence": F.when(key("l_partkey") % 3 == 0, F.lit("load(p)")).otherwise("other"), "severity": _sev(), "confidence": key("l_discount") * 10,
        "tools": F.when(key("l_suppkey") % 3 == 0, F.array().cast("array<string>")).when(key("l_suppkey") % 3 == 1, F.array(F.lit("semgrep"))).otherwise(F.array(F.lit("search"))),
        "chain": key("l_orderkey") % 7 == 0, "fix": F.lit("f"), "test": F.when(key("l_tax") != 0, F.lit("t")),
    }
    got = R.gate_reasons(found)
    return table(spark, sf, "lineitem").select(F.when(F.size(got) > 0, F.array_join(got, ",")).alias("reasons")).groupBy("reasons").agg(F.count("*").alias("findings"))


@query("""select verdict, count(*)::bigint as tests from (select case when b is null then 'new' when a is null then 'missing-regression' when b <> 'failed' and a = 'failed' then 'regression' when b = 'failed' and a = 'passed' then 'fixed' else 'same' end as verdict
from (select l_partkey, max(case l_returnflag when 'A' then 3 when 'R' then 2 else 1 end) as rb, case rb when 3 then 'failed' when 2 then 'passed' else 'skipped' end as b from lineitem where l_linenumber % 2 = 0 group by l_partkey)
full join (select l_partkey, max(case l_returnflag when 'A' then 3 when 'R' then 2 else 1 end) as ra, case ra when 3 then 'failed' when 2 then 'passed' else 'skipped' end as a from lineitem where l_linenumber % 2 = 1 group by l_partkey) using (l_partkey)) group by all""")
def test_outcomes_compared(spark, sf):
    """Outcomes of a test merge by precedence (failed, passed, skipped); before and after meet in a full join; a test that vanished is a regression."""
    rank = F.max(F.when(F.col("l_returnflag") == "A", 3).when(F.col("l_returnflag") == "R", 2).otherwise(1))
    name = F.when(rank == 3, "failed").when(rank == 2, "passed").otherwise("skipped")
    runs = table(spark, sf, "lineitem")
    before = runs.where("l_linenumber % 2 = 0").groupBy("l_partkey").agg(name.alias("b"))
    after = runs.where("l_linenumber % 2 = 1").groupBy("l_partkey").agg(name.alias("a"))
    b, a = F.col("b"), F.col("a")
    verdict = F.when(b.isNull(), "new").when(a.isNull(), "missing-regression").when((b != "failed") & (a == "failed"), "regression").when((b == "failed") & (a == "passed"), "fixed").otherwise("same")
    return before.join(after, "l_partkey", "full").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("tests"))


_ROUNDS = "(select user_id as alert_id, arg_min(event_type, event_id) as x from events where event_id % 3 = 0 group by 1) full join (select user_id as alert_id, arg_max(event_type, event_id) as y from events where event_id % 3 = 1 and user_id % 5 <> 0 group by 1) using (alert_id)"


def _rounds(spark, sf):
    log = table(spark, sf, "events")
    x = log.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("alert_id")).agg(F.min_by("event_type", "event_id").alias("x"))
    y = log.where("event_id % 3 = 1 and user_id % 5 <> 0").groupBy(F.col("user_id").alias("alert_id")).agg(F.max_by("event_type", "event_id").alias("y"))
    return x.join(y, "alert_id", "full")


@query(f"""select paired, first_only, second_only, agreed, round(agreed::double / nullif(paired, 0), 4) as agreement from (select count_if(x is not null and y is not null)::bigint as paired, count_if(y is null)::bigint as first_only, count_if(x is null)::bigint as second_only, count_if(x = y)::bigint as agreed from {_ROUNDS})""")
def paired_rounds(spark, sf):
    """Two labelling rounds: what both judged, what only one did, and how often they agree."""
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    out = _rounds(spark, sf).agg(F.count_if(both).alias("paired"), F.count_if(F.col("y").isNull()).alias("first_only"), F.count_if(F.col("x").isNull()).alias("second_only"), F.count_if(F.col("x") == F.col("y")).alias("agreed"))
    return out.withColumn("agreement", ratio(F.col("agreed"), F.col("paired")))


@query("""select l_returnflag, n, agreement, kappa, case when kappa is not null and agreement is not null then kappa >= 0.6 and agreement >= 0.85 end as meets from (select l_returnflag, n, round(po, 4) as agreement, case when pe < 1 then round((po - pe) / (1 - pe), 4) end as kappa from
(select l_returnflag, sum(c)::bigint as n, sum(case when a = b then c else 0 end)::double / sum(c) as po, (sum(case when a then c else 0 end)::double * sum(case when b then c else 0 end) + sum(case when not a then c else 0 end)::double * sum(case when not b then c else 0 end)) / (sum(c)::double * sum(c)) as pe
from (select l_returnflag, l_quantity > 25 as a, l_extendedprice > 25000 as b, count(*) as c from lineitem group by all) group by all))""")
def judge_calibration(spark, sf):
    """Agreement and kappa of two judges of a yes-or-no label, and a tri-state gate; cells are counted first."""
    cells = table(spark, sf, "lineitem").groupBy("l_returnflag", (F.col("l_quantity") > 25).alias("a"), (F.col("l_extendedprice") > 25000).alias("b")).agg(F.count("*").alias("c"))
    part = lambda test: F.sum(F.when(test, F.col("c")).otherwise(0)).cast("double")
    n, a, b = F.sum("c").cast("double"), F.col("a"), F.col("b")
    sums = cells.groupBy("l_returnflag").agg(F.sum("c").alias("n"), (part(a == b) / n).alias("po"), ((part(a) * part(b) + part(~a) * part(~b)) / (n * n)).alias("pe"))
    kappa = F.when(F.col("pe") < 1, F.round((F.col("po") - F.col("pe")) / (1 - F.col("pe")), 4))
    out = sums.select("l_returnflag", "n", F.round("po", 4).alias("agreement"), kappa.alias("kappa"))
    return out.withColumn("meets", R.calibrated(F.col("kappa"), F.col("agreement")))


_ARMS = "(select l_suppkey % 50 as skill, count_if(l_returnflag = 'A' and l_linenumber % 2 = 0)::bigint as bh, count_if(l_linenumber % 2 = 0)::bigint as bn, count_if(l_quantity > 40 and l_linenumber % 2 = 1 and l_suppkey % 50 <> 7)::bigint as ch, count_if(l_linenumber % 2 = 1 and l_suppkey % 50 <> 7)::bigint as cn from lineitem group by 1)"


def _arms(spark, sf):
    odd, even = "l_linenumber % 2 = 1 and l_suppkey % 50 <> 7", "l_linenumber % 2 = 0"
    counts = {"bh": f"l_returnflag = 'A' and {even}", "bn": even, "ch": f"l_quantity > 40 and {odd}", "cn": odd}
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 50).alias("skill")).agg(*(F.count_if(F.expr(e)).alias(n) for n, e in counts.items()))


@query(f"""select skill, case when bn > 0 and cn > 0 then c_low > b_high or b_low > c_high end as significant from (select skill, bn, cn, {_wilson_sql('bh', 'bn', '-')} as b_low, {_wilson_sql('bh', 'bn', '+')} as b_high, {_wilson_sql('ch', 'cn', '-')} as c_low, {_wilson_sql('ch', 'cn', '+')} as c_high from {_ARMS})""")
def significance(spark, sf):
    """Whether the arms' intervals don't meet; null where one arm has no sample."""
    bh, bn, ch, cn = map(F.col, ("bh", "bn", "ch", "cn"))
    return _arms(spark, sf).select("skill", R.disjoint(wilson(ch, cn, False), wilson(ch, cn, True), wilson(bh, bn, False), wilson(bh, bn, True)).alias("significant"))


@query(f"""select skill, round(c - b, 4) as delta, coalesce(c <= b, false) as not_worse, case when cn = bn then b is null or coalesce(c + 0.02 >= b, false) else ch >= bh end as severity_holds, case when b is null then c is not null end as was_unmeasurable from (select *, round(bh::double / nullif(bn, 0), 4) as b, round(ch::double / nullif(cn, 0), 4) as c from {_ARMS})""")
def arm_comparison(spark, sf):
    """Null-propagating difference of two arms, the lower-is-better gate, and the severity verdict (hits where denominators differ)."""
    rates = _arms(spark, sf).withColumns({"b": ratio(F.col("bh"), F.col("bn")), "c": ratio(F.col("ch"), F.col("cn"))})
    b, c = F.col("b"), F.col("c")
    holds = R.severity_verdict(F.col("cn"), F.col("bn"), F.col("ch"), F.col("bh"), c, b, 0.02)
    return rates.select("skill", F.round(c - b, 4).alias("delta"), not_worse(c, b).alias("not_worse"), holds.alias("severity_holds"), F.when(b.isNull(), c.isNotNull()).alias("was_unmeasurable"))


@query(f"""select skill, case when bn < 10 then 'deferred' when b is not null and not coalesce(c + 0.01 >= b, false) then 'rejected' when coalesce(c > b, false) then 'activated' else 'rejected' end as decision,
list_aggregate(list_filter([case when b is null then 'baseline' end, case when c is null then 'candidate' end], lambda x: x is not null), 'string_agg', ',') as unmeasurable from (select *, round(bh::double / nullif(bn, 0), 4) as b, round(ch::double / nullif(cn, 0), 4) as c from {_ARMS})""")
def release_decision(spark, sf):
    """Deferred for want of samples, rejected where a protected rate falls, activated where it rises; what couldn't be measured is listed."""
    rates = _arms(spark, sf).withColumns({"b": ratio(F.col("bh"), F.col("bn")), "c": ratio(F.col("ch"), F.col("cn"))})
    b, c = F.col("b"), F.col("c")
    decision = F.when(F.col("bn") < 10, "deferred").when(~non_regressing(c, b, 0.01), "rejected").when(F.coalesce(c > b, F.lit(False)), "activated").otherwise("rejected")
    missing = R.reasons({"baseline": b.isNull(), "candidate": c.isNull()})
    return rates.select("skill", decision.alias("decision"), F.when(F.size(missing) > 0, F.array_join(missing, ",")).alias("unmeasurable"))


@query("""select case when n >= 60 then 'frequent' else 'sporadic' end as class, event_type, count(*)::bigint as fingerprints, sum(n)::bigint as cases from (select event_type, user_id % 97 as fp, count(*) as n from events group by all) group by all""")
def occurrence_partition(spark, sf):
    by = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 97).alias("fp")).agg(F.count("*").alias("n"))
    return by.groupBy(F.when(F.col("n") >= 60, "frequent").otherwise("sporadic").alias("class"), "event_type").agg(F.count("*").alias("fingerprints"), F.sum("n").alias("cases"))


@query("""select user_id as tenant, count(*)::bigint as samples, round(count_if(event_type = 'error')::double / count(*), 4) as rate from events group by all having count(*) >= 20 and count_if(event_type = 'error')::double / count(*) > 0.2""")
def failure_rate_alerts(spark, sf):
    bad, n = F.count_if(F.col("event_type") == "error"), F.count("*")
    out = table(spark, sf, "events").groupBy(F.col("user_id").alias("tenant")).agg(n.alias("samples"), ratio(bad, n).alias("rate"), (bad / n).alias("exact"))
    return out.where("samples >= 20 and exact > 0.2").drop("exact")


@query("""select c_custkey as tenant, not exists (select 1 from orders o where o.o_custkey = c.c_custkey) or exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_orderpriority = '1-URGENT') as allowed from customer c""")
def grants(spark, sf):
    """A tenant without any grant may do all, one with grants needs a match; grants are aggregated before the join."""
    held = table(spark, sf, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("fits"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("tenant"))
    return users.join(held, users["tenant"] == held["o_custkey"], "left").select("tenant", F.coalesce("fits", F.lit(True)).alias("allowed"))


@query("""select label, count(*)::bigint as alerts from (select case when line > 4 then 'unlabelled' when not factual then 'invalid' when not related then 'valid-but-noise' else 'valid' end as label from (select l_linenumber as line, l_returnflag <> 'N' as factual, l_linestatus = 'F' as related from lineitem)) group by all""")
def label_order(spark, sf):
    """Labels in the order of decision: scope, fact, relation."""
    label = F.when(F.col("l_linenumber") > 4, "unlabelled").when(F.col("l_returnflag") == "N", "invalid").when(F.col("l_linestatus") != "F", "valid-but-noise").otherwise("valid")
    return table(spark, sf, "lineitem").groupBy(label.alias("label")).agg(F.count("*").alias("alerts"))


@query("""select l_suppkey as source, total, judgeable, round(effective::double / nullif(judgeable, 0), 4) as effective_rate, round(strict::double / nullif(judgeable, 0), 4) as strict_rate, round((total - judgeable)::double / nullif(total, 0), 4) as unlabelled_share
from (select l_suppkey, count(*)::bigint as total, count_if(l_linenumber <= 4)::bigint as judgeable, count_if(l_linenumber <= 4 and l_returnflag <> 'N')::bigint as effective, count_if(l_linenumber <= 4 and l_returnflag = 'A')::bigint as strict from lineitem group by all)""")
def effective_alert_rate(spark, sf):
    seen = F.col("l_linenumber") <= 4
    out = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source")).agg(F.count("*").alias("total"), F.count_if(seen).alias("judgeable"), F.count_if(seen & (F.col("l_returnflag") != "N")).alias("e"), F.count_if(seen & (F.col("l_returnflag") == "A")).alias("s"))
    j, t = F.col("judgeable"), F.col("total")
    return out.select("source", "total", "judgeable", ratio(F.col("e"), j).alias("effective_rate"), ratio(F.col("s"), j).alias("strict_rate"), ratio(t - j, t).alias("unlabelled_share"))


@query("""select case_id, tp, fp, fn, case when not failed then case when tp + fp + fn = 0 then 1.0 else round(2.0 * tp / (2 * tp + fp + fn), 4) end end as score from (select l_orderkey as case_id, count_if(l_returnflag = 'A')::bigint as tp, count_if(l_returnflag = 'R')::bigint as fp, count_if(l_returnflag = 'N' and l_quantity > 30)::bigint as fn, bool_or(l_linenumber = 7) as failed from lineitem group by all)""")
def case_scores(spark, sf):
    flag = F.col("l_returnflag")
    cells = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count_if(flag == "A").alias("tp"), F.count_if(flag == "R").alias("fp"), F.count_if((flag == "N") & (F.col("l_quantity") > 30)).alias("fn"), F.bool_or(F.col("l_linenumber") == 7).alias("failed"))
    return cells.withColumn("score", R.case_score(F.col("tp"), F.col("fp"), F.col("fn"), F.col("failed"))).drop("failed")


@query("""select split, coalesce(n, 0)::bigint as cases, coalesce(k, 0)::bigint as hits, round(k::double / nullif(n, 0), 4) as rate from (values ('train'), ('validation'), ('holdout'), ('F'), ('O'), ('P')) d(split) left join (select o_orderstatus as split, count(*) as n, count_if(o_totalprice > 100000) as k from orders group by 1) using (split)""")
def fixed_domain_metrics(spark, sf):
    """A row for every split of the domain; an empty one has no cases and a null rate."""
    domain = spark.createDataFrame([(x,) for x in ("train", "validation", "holdout", "F", "O", "P")], "split string")
    got = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("split")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("k"))
    out = F.broadcast(domain).join(got, "split", "left")
    return out.select("split", F.coalesce("n", F.lit(0)).alias("cases"), F.coalesce("k", F.lit(0)).alias("hits"), ratio(F.col("k"), F.col("n")).alias("rate"))


@query("""select user_id as deployment, count_if(event_id > coalesce(began, -1))::bigint as samples, count_if(event_id > coalesce(began, -1) and event_type = 'error')::bigint as errors, count(*)::bigint as kept from events join (select user_id, max(case when event_type = 'signup' then event_id end) as began from events group by 1) using (user_id) group by all""")
def evidence_since_redeploy(spark, sf):
    """Counters start anew with the last deployment of each key, history stays."""
    log = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    start = log.groupBy("user_id").agg(F.coalesce(F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))), F.lit(-1)).alias("at"))
    since = F.col("event_id") > F.col("at")
    return log.join(start, "user_id").groupBy(F.col("user_id").alias("deployment")).agg(F.count_if(since).alias("samples"), F.count_if(since & (F.col("event_type") == "error")).alias("errors"), F.count("*").alias("kept"))


@query("""select candidate, case when status <> 'running' then 'insufficient' when version is null then 'insufficient' when samples < 100 then 'insufficient' when failures > 0 then 'reject' when losses::double / nullif(samples, 0) > 0.5 then 'reject' when errors::double / nullif(samples, 0) > 0.22 then 'reject' when wins < 1 then 'insufficient' else 'promote' end as verdict
from (select user_id as candidate, case when user_id % 11 = 0 then 'rolled_back' else 'running' end as status, case when user_id % 13 <> 0 then user_id end as version, count(*)::bigint as samples, count_if(value > 990) as failures, count_if(event_type = 'view') as losses, count_if(event_type = 'error') as errors, count_if(event_type = 'purchase') as wins from events group by all)""")
def promotion_rules(spark, sf):
    """The seven ordered rules from shadow evidence to promotion: want of evidence is no rejection."""
    kind, n = F.col("event_type"), F.count("*")
    facts = table(spark, sf, "events").groupBy(F.col("user_id").alias("candidate")).agg(n.alias("samples"), F.count_if(F.col("value") > 990).alias("failures"), *(F.count_if(kind == k).alias(c) for k, c in (("view", "losses"), ("error", "errors"), ("purchase", "wins"))))
    c, s = F.col("candidate"), F.col("samples")
    rules = ((c % 11 == 0, "insufficient"), (c % 13 == 0, "insufficient"), (s < 100, "insufficient"), (F.col("failures") > 0, "reject"), (F.try_divide("losses", "samples") > 0.5, "reject"), (F.try_divide("errors", "samples") > 0.22, "reject"), (F.col("wins") < 1, "insufficient"))
    return facts.select("candidate", F.coalesce(*(F.when(test, F.lit(v)) for test, v in rules), F.lit("promote")).alias("verdict"))


@query("""select l_shipdate as day, coalesce(sum(case when reported > 0 then reported else round((l_quantity * 3 + l_linenumber * 15) / 1e6, 8) end), 0)::decimal(38, 8)::double as cost from (select *, case when l_orderkey % 3 = 0 then l_linenumber / 1e6 end as reported from lineitem) group by all""")
def reported_or_estimated_cost(spark, sf):
    """A reported cost wins over tokens times rates; sums are decimals, so that their order doesn't matter."""
    reported = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_linenumber") / 1e6)
    estimate = F.round((F.col("l_quantity") * 3 + F.col("l_linenumber") * 15) / 1e6, 8)
    cost = F.when(reported > 0, reported).otherwise(estimate)
    return table(spark, sf, "lineitem").groupBy(F.col("l_shipdate").alias("day")).agg(F.sum(cost.cast("decimal(28,8)")).cast("double").alias("cost"))


@query("""select verdict, count(*)::bigint as rows_seen, count(distinct user_id)::bigint as tenants from (select user_id, case when event_type not in ('error', 'purchase', 'view') then 'invalid' when value is null then 'missing' when props = '' then 'missing' else 'valid' end as verdict from events) group by all""")
def label_validation(spark, sf):
    """Valid, missing and invalid labels are counted apart."""
    verdict = F.when(~F.col("event_type").isin("error", "purchase", "view"), "invalid").when(F.col("value").isNull() | (F.col("props") == ""), "missing").otherwise("valid")
    return table(spark, sf, "events").groupBy(verdict.alias("verdict")).agg(F.count("*").alias("rows_seen"), F.count_distinct("user_id").alias("tenants"))


@query("""select delivery, event_id, user_id from (select event_id as delivery, event_id, user_id, ts from events where event_type = 'error') order by ts desc, event_id desc limit 200""")
def dead_letters(spark, sf):
    """The dead letters' list, newest first, at most 200: the list's own limit."""
    dead = table(spark, sf, "events").where("event_type = 'error'").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    return dead.select(F.col("event_id").alias("delivery"), "event_id", "user_id")


@query("""select requested || '/' || can as mode, count(*)::bigint as tasks, case when requested = can then requested when can = 'none' then 'rules' else can end as effective, case when requested <> can then 'capability' end as reason from (select case when o_orderstatus = 'F' then 'agentic' when o_orderstatus = 'O' then 'single' else 'rules' end as requested, case o_orderpriority when '1-URGENT' then 'agentic' when '2-HIGH' then 'single' else 'none' end as can from orders) group by all""")
def mode_resolution(spark, sf):
    asked = F.when(F.col("o_orderstatus") == "F", "agentic").when(F.col("o_orderstatus") == "O", "single").otherwise("rules")
    can = F.when(F.col("o_orderpriority") == "1-URGENT", "agentic").when(F.col("o_orderpriority") == "2-HIGH", "single").otherwise("none")
    by = table(spark, sf, "orders").groupBy(asked.alias("asked"), can.alias("can")).agg(F.count("*").alias("tasks"))
    a, c = F.col("asked"), F.col("can")
    return by.select(F.concat(a, F.lit("/"), c).alias("mode"), "tasks", F.when(a == c, a).when(c == "none", "rules").otherwise(c).alias("effective"), F.when(a != c, "capability").alias("reason"))
