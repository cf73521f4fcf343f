"""Reads of the operational store: counts, dashboards, latest rows, idempotent logs, rollout evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlytics.functions.metrics import bucket, ratio
from revlytics.operators import changelog
from revlytics.operators.numbering import running
from revlytics.plans.registry import query, table


@query("""select c_mktsegment as tenant, l_linestatus as category, count(*)::bigint as failures from lineitem join orders on l_orderkey = o_orderkey
join customer on o_custkey = c_custkey where l_returnflag = 'R' group by all""")
def tenant_failure_counts(spark, sf):
    failed = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linestatus")
    # Failures carry no tenant: it comes through their order. Counted by order first, so the join takes fewer rows.
    failed = failed.groupBy("l_orderkey", "l_linestatus").agg(F.count("*").alias("n"))
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer")
    joined = failed.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.col("c_mktsegment").alias("tenant"), F.col("l_linestatus").alias("category")).agg(F.sum("n").alias("failures"))


@query("""select n_name as tenant, count(o_orderkey)::bigint as tasks, count_if(o_orderstatus = 'F')::bigint as succeeded, count_if(o_orderstatus = 'O')::bigint as open,
coalesce(round(count_if(o_orderstatus = 'F')::double / nullif(count(o_orderkey), 0), 4), 0.0) as success_rate
from nation left join customer on c_nationkey = n_nationkey left join orders on o_custkey = c_custkey group by n_name""")
def tenant_dashboard(spark, sf):
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    is_ = lambda s: F.coalesce(F.count_if(F.col("o_orderstatus") == s), F.lit(0))
    rows = n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(o, F.col("o_custkey") == F.col("c_custkey"), "left")
    out = rows.groupBy(F.col("n_name").alias("tenant")).agg(F.count("o_orderkey").alias("tasks"), is_("F").alias("succeeded"), is_("O").alias("open"))
    return out.withColumn("success_rate", F.coalesce(ratio(F.col("succeeded"), F.col("tasks")), F.lit(0.0)))


@query("""select o_custkey as repository, o_orderkey as task_id, o_totalprice as score from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn
from orders where o_orderstatus = 'F') where rn = 1""")
def latest_task_per_key(spark, sf):
    log = table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return changelog.latest(log, ["o_custkey"], ["o_orderdate", "o_orderkey"]).select(F.col("o_custkey").alias("repository"), F.col("o_orderkey").alias("task_id"), F.col("o_totalprice").alias("score"))


@query("""select conv_id, count(*)::bigint as messages, string_agg(distinct role, ',' order by role) as roles, max(turn) as last_round, arg_max(role, turn) as last_role,
sum(length(text))::bigint as chars from conversations group by conv_id""")
def task_with_messages(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"), F.max("turn").alias("last_round"),
        F.max_by("role", "turn").alias("last_role"), F.sum(F.length("text").cast("long")).alias("chars"),
    )


@query("""select coalesce(b.role, '<start>') as from_state, a.role as to_state, count(*)::bigint as n,
(coalesce(b.role, '<start>') || '>' || a.role) in ('<start>>system', '<start>>user', 'system>user', 'user>assistant', 'assistant>user') as legal
from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn + 1 = a.turn group by all""")
def state_transition_audit(spark, sf):
    now = table(spark, sf, "conversations").select("conv_id", "turn", F.col("role").alias("to_state"))
    # Turns are numbered, so the state before is an equi-join: a long conversation spreads over all tasks.
    before = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("from_state"))
    pairs = now.join(before, ["conv_id", "turn"], "left").select(F.coalesce("from_state", F.lit("<start>")).alias("from_state"), "to_state")
    legal = F.concat_ws(">", "from_state", "to_state").isin("<start>>system", "<start>>user", "system>user", "user>assistant", "assistant>user")
    return pairs.groupBy("from_state", "to_state").agg(F.count("*").alias("n")).withColumn("legal", legal)


@query("""select substr(sha256(event_type || chr(31) || props), 1, 16) as fingerprint, count(distinct user_id)::bigint as attempts, count(*)::bigint as rows_seen from events group by all""")
def distinct_attempts_by_fingerprint(spark, sf):
    fp = F.substring(F.sha2(F.concat_ws("\x1f", "event_type", "props"), 256), 1, 16).alias("fingerprint")
    return table(spark, sf, "events").groupBy(fp).agg(F.count_distinct("user_id").alias("attempts"), F.count("*").alias("rows_seen"))


@query("""select user_id % 4 as candidate, count(*)::bigint as samples, count_if(event_type = 'error')::bigint as failures, round(count_if(event_type = 'error')::double / nullif(count(*), 0), 4) as failure_rate,
count_if(event_type = 'purchase' and value > 50)::bigint as agreements, round(count_if(event_type = 'purchase' and value > 50)::double / nullif(count_if(event_type = 'purchase'), 0), 4) as agreement_rate from events group by all""")
def shadow_evidence(spark, sf):
    failed, asked = F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") == "purchase")
    agreed = F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 50))
    return table(spark, sf, "events").groupBy((F.col("user_id") % 4).alias("candidate")).agg(
        F.count("*").alias("samples"), failed.alias("failures"), ratio(failed, F.count("*")).alias("failure_rate"), agreed.alias("agreements"), ratio(agreed, asked).alias("agreement_rate")
    )


@query("""select candidate, max(samples)::bigint as samples, max(failures)::bigint as failures, min(case when samples >= 20 and failures * 100 > 22 * samples then event_id end) as tripped_at from (
select user_id % 4 as candidate, event_id, count(*) over w as samples, count_if(event_type = 'error') over w as failures from events window w as (partition by user_id % 4 order by event_id)) group by candidate""")
def canary_error_budget(spark, sf):
    """Sticky roll-back: the first event at which samples >= 20 and over 22 % failed. Prefix sums by block, so a candidate's events don't meet in one task."""
    log = table(spark, sf, "events").select((F.col("user_id") % 4).alias("candidate"), "event_id", "event_type")
    sums = {"samples": F.lit(1).cast("long"), "failures": (F.col("event_type") == "error").cast("long")}
    so_far = running(log, ["candidate"], F.expr("event_id div 50000"), [F.col("event_id")], sums)
    tripped = (F.col("samples") >= 20) & (F.col("failures") * 100 > 22 * F.col("samples"))
    return so_far.groupBy("candidate").agg(F.max("samples").alias("samples"), F.max("failures").alias("failures"), F.min(F.when(tripped, F.col("event_id"))).alias("tripped_at"))


@query("""select candidate, samples, case when samples < 100 then 'insufficient' when agree is null then 'insufficient' when rate > 0.21 then 'reject' when agree < 0.2 then 'reject' else 'promote' end as verdict
from (select user_id % 7 as candidate, count(*)::bigint as samples, round(count_if(event_type = 'error')::double / count(*), 4) as rate,
round(count_if(event_type = 'purchase' and value > 50)::double / nullif(count_if(event_type = 'purchase'), 0), 4) as agree from events group by all)""")
def promotion_verdict(spark, sf):
    asked = F.count_if(F.col("event_type") == "purchase")
    agreed = F.count_if((F.col("event_type") == "purchase") & (F.col("value") > 50))
    facts = table(spark, sf, "events").groupBy((F.col("user_id") % 7).alias("candidate")).agg(
        F.count("*").alias("samples"), ratio(F.count_if(F.col("event_type") == "error"), F.count("*")).alias("rate"), ratio(agreed, asked).alias("agree")
    )
    verdict = F.when(F.col("samples") < 100, "insufficient").when(F.col("agree").isNull(), "insufficient").when(F.col("rate") > 0.21, "reject").when(F.col("agree") < 0.2, "reject")
    return facts.select("candidate", "samples", verdict.otherwise("promote").alias("verdict"))


@query("""select c_custkey as task_id, b as bucket, case when b < 10 then 'canary' else 'stable' end as lane, b >= 90 as shadow from (select c_custkey, ('0x' || substr(sha256(c_name), 1, 8))::bigint % 100 as b from customer)""")
def lane_assignment(spark, sf):
    b = F.col("bucket")
    out = table(spark, sf, "customer").select(F.col("c_custkey").alias("task_id"), bucket(F.col("c_name")).alias("bucket"))
    return out.withColumns({"lane": F.when(b < 10, "canary").otherwise("stable"), "shadow": b >= 90})


@query("""select user_id, count_if(early and not late)::bigint as lost, count_if(late and not early)::bigint as added, count(*)::bigint as seen,
round((count_if(early and not late) + count_if(late and not early))::double / count(*), 4) as disagreement
from (select user_id, event_type, bool_or(event_id % 2 = 0) as early, bool_or(event_id % 2 = 1) as late from events group by all) group by user_id""")
def disagreement_direction(spark, sf):
    """What one arm found and the other didn't, each way, over the union; by flags of each (user, key), not by gathered sets."""
    flags = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.bool_or(F.col("event_id") % 2 == 0).alias("early"), F.bool_or(F.col("event_id") % 2 == 1).alias("late"))
    lost, added = F.count_if(F.col("early") & ~F.col("late")), F.count_if(F.col("late") & ~F.col("early"))
    return flags.groupBy("user_id").agg(lost.alias("lost"), added.alias("added"), F.count("*").alias("seen"), ratio(lost + added, F.count("*")).alias("disagreement"))


@query("""select delivery_id, min(event_id) as event_id, arg_min(event_type, event_id) as event_type, count(*)::bigint as deliveries, count(distinct event_type) > 1 as conflict
from (select *, props || ':' || (user_id % 50)::varchar as delivery_id from events) group by delivery_id""")
def webhook_idempotency(spark, sf):
    log = table(spark, sf, "events").select(F.concat("props", F.lit(":"), (F.col("user_id") % 50).cast("string")).alias("delivery_id"), "event_id", "event_type")
    one = F.min_by(F.struct("event_id", "event_type"), "event_id").alias("one")
    claims = log.groupBy("delivery_id").agg(one, F.count("*").alias("deliveries"), (F.min("event_type") != F.max("event_type")).alias("conflict"))
    return claims.select("delivery_id", "one.event_id", "one.event_type", "deliveries", "conflict")


@query("""select user_id as memory_id, max(value) as importance, arg_max(event_type, event_id) as scope, arg_min(props, event_id) as content from events group by user_id""")
def upsert_max_merge(spark, sf):
    """Upsert with a merge function: importance by maximum, scope from the last write, content from the first."""
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("memory_id")).agg(
        F.max("value").alias("importance"), F.max_by("event_type", "event_id").alias("scope"), F.min_by("props", "event_id").alias("content")
    )


@query("""select user_id as tenant, event_type as alert_key, min(event_id) as event_id, arg_min(value, event_id) as value from events where event_type in ('error', 'signup') group by all""")
def first_wins_alerts(spark, sf):
    log = table(spark, sf, "events").where(F.col("event_type").isin("error", "signup")).select(F.col("user_id").alias("tenant"), F.col("event_type").alias("alert_key"), "event_id", "value")
    return changelog.first(log, ["tenant", "alert_key"], ["event_id"])


@query("""select source, count(*)::bigint as names, count_if(n > 1)::bigint as conflicts from (select source, split_part(text, ' ', 1) as name, count(distinct sha256(text)) as n from documents group by all) group by source""")
def immutable_insert_conflicts(spark, sf):
    docs = table(spark, sf, "documents").select("source", F.split_part("text", F.lit(" "), F.lit(1)).alias("name"), F.sha2("text", 256).alias("content"))
    return changelog.immutable(docs, ["source", "name"], "content").groupBy("source").agg(F.count("*").alias("names"), F.count_if("conflict").alias("conflicts"))


@query("""select o_custkey as skill, max(version)::bigint as versions, max(case when o_orderstatus = 'F' then version end)::bigint as active from (
select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version from orders) group by o_custkey""")
def active_version(spark, sf):
    """Versions allocated in order; the active one is the last that was activated."""
    log = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    numbered = running(log, ["o_custkey"], F.date_trunc("year", "o_orderdate"), [F.col("o_orderdate"), F.col("o_orderkey")], {"version": F.lit(1).cast("long")})
    return numbered.groupBy(F.col("o_custkey").alias("skill")).agg(F.max("version").alias("versions"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("version"))).alias("active"))


@query("""select role, sum(calls)::bigint as calls, sum(tokens)::bigint as tokens, round(sum(calls)::double / (select count(distinct conv_id) from conversations), 4) as calls_per_case
from (select role, 1 as calls, greatest(1, (octet_length(encode(text)) + 3) // 4) as tokens from conversations) group by role""")
def role_cost(spark, sf):
    """Role totals with the number of all cases as denominator, also for roles that not every case has."""
    log = table(spark, sf, "conversations")
    tokens = F.greatest(F.lit(1), F.expr("(octet_length(text) + 3) div 4"))
    cases = log.select(F.count_distinct("conv_id")).scalar()
    by_role = log.groupBy("role").agg(F.count("*").alias("calls"), F.sum(tokens).cast("long").alias("tokens"))
    return by_role.select("role", "calls", "tokens", ratio(F.col("calls"), cases).alias("calls_per_case"))


@query("""with v as (select l_partkey as case_id, l_suppkey as version, max(l_extendedprice) as score from lineitem group by all), m as (select case_id, max(score) as best from v group by all)
select version, count(*)::bigint as cases_led from v join m using (case_id) where score = best group by version""")
def pareto_frontier(spark, sf):
    """Versions that attain the best score of at least one case, and how many they lead."""
    scores = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("case_id"), F.col("l_suppkey").alias("version")).agg(F.max("l_extendedprice").alias("score"))
    best = scores.groupBy("case_id").agg(F.max("score").alias("best"))
    return scores.join(best, "case_id").where("score = best").groupBy("version").agg(F.count("*").alias("cases_led"))


@query("""with v as (select l_partkey as case_id, l_suppkey as version, max(l_extendedprice) as score from lineitem group by all), m as (select case_id, max(score) as best from v group by all),
f as (select version, count(*)::bigint as n from v join m using (case_id) where score = best group by version), c as (select version, n, sum(n) over (order by version) as upto, sum(n) over () as total from f)
select version, n as weight from c, (select ('0x' || substr(sha256('round-1'), 1, 12))::bigint / 281474976710656.0 as u) where upto > u * total and upto - n <= u * total""")
def parent_choice(spark, sf):
    """A parent drawn from the frontier in proportion to the cases it leads; the draw is a hash of the seed."""
    led = pareto_frontier(spark, sf).withColumnRenamed("cases_led", "weight")
    u = F.conv(F.substring(F.sha2(F.lit("round-1"), 256), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    upto = running(led.withColumn("all", F.lit(0)), ["all"], F.expr("version div 1000"), [F.col("version")], {"upto": F.col("weight")})
    place = u * led.select(F.sum("weight")).scalar()
    return upto.where((F.col("upto") > place) & (F.col("upto") - F.col("weight") <= place)).select("version", "weight")
