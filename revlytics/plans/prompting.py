"""Learned rules of prompts: logs of operations applied as transactions, prompts written and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlytics.operators import prompts
from revlytics.plans.registry import query, table

_OPS = ("add", "replace", "drop", "add", "drop", "replace", "add")


def _entries(spark, sf) -> DataFrame:
    """A customer's rules: one for each remainder of its orders' keys."""
    o = table(spark, sf, "orders").where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("case_id"), (F.col("o_orderkey") % 9).alias("n")).agg(F.min("o_orderkey").alias("k"))
    return o.select("case_id", F.format_string("RULE-%d", "n").alias("rule_id"), F.format_string("Check order %d.", "k").alias("text"), F.when(F.col("n") % 3 == 0, F.format_string("run%d", "n")).otherwise("").alias("run_id"), F.when(F.col("n") % 2 == 0, F.array(F.lit("holdout"), F.lit("safety"))).otherwise(F.array().cast("array<string>")).alias("gates"))


def _log(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    op = F.when(k % 101 == 0, "move").otherwise(F.element_at(F.array(*map(F.lit, _OPS)), (k % 7 + 1).cast("int")))
    return table(spark, sf, "orders").where("o_orderkey % 5 = 1").select(
        F.col("o_custkey").alias("case_id"), k.alias("at"), op.alias("op"), F.when(k % 97 == 0, "rule 1").otherwise(F.format_string(" RULE-%d", k % 31)).alias("rule_id"), F.when(k % 89 == 0, " [src:x]").otherwise(F.format_string("Mind %d [src:old]", k)).alias("text"),
        F.when(k % 4 == 0, F.format_string("new%d", k % 3)).alias("run_id"), F.when(k % 6 == 0, F.array(F.lit("z"), F.lit("a"))).alias("gates"), F.when(k % 83 == 0, " ").otherwise("wrong").alias("reason"),
    )


_SQL = f"""e as (select o_custkey as case_id, 'RULE-' || n as rule_id, 'Check order ' || k || '.' as text, case when n % 3 = 0 then 'run' || n else '' end as run_id, case when n % 2 = 0 then 'holdout,safety' else '' end as gates
 from (select o_custkey, o_orderkey % 9 as n, min(o_orderkey) as k from orders where o_orderkey % 2 = 0 group by all)),
g as (select o_custkey as case_id, o_orderkey as k, case when o_orderkey % 101 = 0 then 'move' else {list(_OPS)}[o_orderkey % 7 + 1] end as op, case when o_orderkey % 97 = 0 then 'rule 1' else 'RULE-' || o_orderkey % 31 end as rule_id,
 case when o_orderkey % 89 = 0 then '' else 'Mind ' || o_orderkey end as text, case when o_orderkey % 4 = 0 then 'new' || o_orderkey % 3 end as run_id, case when o_orderkey % 6 = 0 then 'a,z' end as gates, o_orderkey % 83 = 0 as no_reason from orders where o_orderkey % 5 = 1),
p as (select *, list_filter([case when op = 'move' then 'unknown operation' end, case when rule_id = 'rule 1' then 'not a rule id' end, case when rule_id <> 'rule 1' and row_number() over (partition by case_id, rule_id order by k) > 1 then 'rule more than once' end,
 case when op in ('add', 'replace') and text = '' then 'no text' end, case when op = 'drop' and no_reason then 'no reason' end], lambda x: x is not null) as problems from g),
v as (select *, max(len(problems)) over (partition by case_id) > 0 as voided from p),
j as (select coalesce(e.case_id, v.case_id) as case_id, coalesce(e.rule_id, v.rule_id) as rule_id, e.rule_id is not null as here, e.text, e.run_id, e.gates, v.k, v.op, v.text as new_text, v.run_id as new_run, v.gates as new_gates,
 v.k is not null and (case when v.op = 'add' then e.rule_id is null else e.rule_id is not null end) as done from e full join (select * from v where not voided) v on e.case_id = v.case_id and e.rule_id = v.rule_id),
a as (select case_id, rule_id, case when done and op <> 'drop' then new_text else text end as text, coalesce(case when done and op <> 'drop' then new_run end, run_id, '') as run_id, coalesce(case when done and op <> 'drop' then new_gates end, gates, '') as gates
 from j where (here and not (done and op = 'drop')) or (done and op <> 'drop'))"""


@query(f"""with {_SQL} select case_id, k as at, op, rule_id, case when done then 'applied' else 'rejected' end as outcome, '' as problems, case when done and op = 'drop' then text end as dropped_text from j where k is not null
union all select case_id, k, op, rule_id, case when len(problems) > 0 then 'problem' else 'voided' end, array_to_string(problems, ','), null from v where voided""")
def rule_log_outcomes(spark, sf):
    """What became of every operation of every customer's log."""
    _, outcomes = prompts.apply_log(_entries(spark, sf), _log(spark, sf), "case_id")
    return outcomes.withColumn("problems", F.array_join("problems", ","))


def _bodies(spark, sf) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("case_id"), F.format_string("Review for %s.\n- keep calm\n \n", "c_name").alias("body"), F.when(k % 3 == 0, F.array(F.lit("Avoid style."), F.lit(" "), F.lit("Be brief"))).alias("unstructured"))


@query(f"""with {_SQL}, r as (select case_id, string_agg(rtrim(text, '.') || ' [focus-rule:' || rule_id || '].' || case when run_id <> '' then ' [src:' || run_id || ']' else '' end || case when gates <> '' then ' [gates:' || gates || ']' else '' end, chr(10) || '- ' order by rule_id) as rules from a group by case_id),
l as (select c_custkey as case_id, 'Review for ' || c_name || '.' || chr(10) || '- keep calm' as body, concat_ws(chr(10) || '- ', case when c_custkey % 3 = 0 then 'Avoid style.' || chr(10) || '- Be brief' end, rules) as lines from customer left join r on case_id = c_custkey)
select case_id, body || case when lines <> '' then chr(10) || chr(10) || 'Learned constraints:' || chr(10) || '- ' || lines else '' end as prompt from l""")
def composed_prompts(spark, sf):
    """Every customer's prompt after its log: rules by id, general constraints first and in order."""
    after, _ = prompts.apply_log(_entries(spark, sf), _log(spark, sf), "case_id")
    return prompts.composed(_bodies(spark, sf), after, "case_id")


@query(f"""with {_SQL}, b as (select case_id, list_sort(list(rule_id)) as ids, list(rtrim(text, '.') || ' [focus-rule:' || rule_id || '].' order by rule_id) as items from e group by case_id),
c as (select case_id, list_sort(list(rule_id)) as ids, list(rtrim(text, '.') || ' [focus-rule:' || rule_id || '].') as items from a group by case_id),
k as (select c_custkey as case_id, coalesce(b.ids, []) as b, coalesce(c.ids, []) as c, coalesce(b.items, []) as bi, coalesce(c.items, []) as ci, case when c_custkey % 2 = 0 then ['RULE-1', 'RULE-3', 'RULE-5'] else [] end as ok from customer left join b on b.case_id = c_custkey left join c on c.case_id = c_custkey),
d as (select *, list_filter(b, lambda x: not list_contains(c, x)) as gone from k)
select case_id, case when len(b) > 0 then len(list_filter(gone, lambda x: not list_contains(ok, x))) = 0 end as passed, array_to_string(list_filter(gone, lambda x: not list_contains(ok, x)), ',') as undeclared, array_to_string(list_filter(gone, lambda x: list_contains(ok, x)), ',') as declared,
array_to_string(list_filter(c, lambda x: not list_contains(b, x)), ',') as added, len(list_filter(bi, lambda x: not list_contains(ci, x)))::bigint as dropped_constraints from d""")
def rule_retention(spark, sf):
    """Whether each customer's prompt keeps its verified rules after the log; rules 1, 3 and 5 may go in every second case."""
    entries = _entries(spark, sf)
    after, _ = prompts.apply_log(entries, _log(spark, sf), "case_id")
    before, now = (prompts.composed(_bodies(spark, sf), e, "case_id") for e in (entries, after))
    pairs = before.withColumnRenamed("prompt", "baseline").join(now.withColumnRenamed("prompt", "candidate"), "case_id")
    out = prompts.retention(pairs, "case_id", "baseline", "candidate", F.when(F.col("case_id") % 2 == 0, F.array(F.lit("RULE-1"), F.lit("RULE-3"), F.lit("RULE-5"))))
    joined = lambda c: F.array_join(c, ",")
    return out.select("case_id", "passed", joined("undeclared").alias("undeclared"), joined("declared").alias("declared"), joined("added_rule_ids").alias("added"), F.size("dropped_constraints").cast("long").alias("dropped_constraints"))
