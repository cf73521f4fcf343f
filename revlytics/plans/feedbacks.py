"""Feedback imported, promoted, written and triaged, over rows that orders and parts make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlytics.operators import feedback
from revlytics.operators.learning import learned_rules, without_deleted
from revlytics.plans.corpus import _PATH, _diffs
from revlytics.plans.registry import query, table

_LABELS = ("valid", "valid-but-noise", "invalid", "unlabelled", "should-have-caught", "not-expected", "", "odd")
_KINDS = ("unmatched_finding", "unmatched_expected", "other")


def _pick(values: tuple, k) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


@query(f"""with c as (select o_orderkey as at, 'c' || o_custkey as candidate_id, {_list(_KINDS)}[o_orderkey // 8 % 3 + 1] as kind, {_list(_LABELS)}[o_orderkey % 8 + 1] as label from orders),
o as (select *, case when label = '' then 'unconfirmed' when not ((kind = 'unmatched_finding' and label in ('valid', 'valid-but-noise', 'invalid', 'unlabelled')) or (kind = 'unmatched_expected' and label in ('should-have-caught', 'not-expected', 'unlabelled'))) then 'rejected'
 when label not in ('invalid', 'should-have-caught') then 'not_feedback' end as early from c),
f as (select candidate_id, min("at") as first from o where early is null group by all)
select "at", candidate_id, coalesce(early, case when substr(candidate_id, 2)::bigint % 9 = 0 or "at" > first then 'already_imported' else 'imported' end) as outcome,
case when early is null and substr(candidate_id, 2)::bigint % 9 > 0 and "at" = first then case label when 'invalid' then 'false_positive' else 'missed_issue' end end as category from o left join f using (candidate_id)""")
def imported_labels(spark, sf):
    """What became of every labelled candidate; customers whose key is divisible by 9 were imported before."""
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(k.alias("at"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("candidate_id"), _pick(_KINDS, F.expr("o_orderkey div 8")).alias("kind"), _pick(_LABELS, k).alias("label"))
    present = table(spark, sf, "customer").where("c_custkey % 9 = 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("candidate_id"))
    return feedback.imported(rows, present).select("at", "candidate_id", "outcome", "category")


_CATEGORIES = ("missed_issue", "false_positive", "bad_fix", "missed_issue", "execution_error", "false_positive", "accepted")
_SEVERITIES = ("low", "HIGH", " medium ", "", "odd")


def _promoted(spark, sf) -> DataFrame:
    part = table(spark, sf, "part")
    side = F.when(F.substring("p_brand", -1, 1).cast("int") % 3 == 0, "holdout").otherwise("validation")
    corpus = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 50 > 0, F.col("p_brand")).otherwise("").alias("repository"), side.alias("split"), (F.col("p_size") % 2).alias("n_expected")).join(_diffs(spark, sf).withColumnRenamed("case_id", "id"), "id")
    corpus = corpus.withColumn("diff", F.when(F.col("id") % 17 > 0, F.col("diff")).otherwise("no diff"))
    k = F.col("o_orderkey")
    asked = table(spark, sf, "orders").select(k.alias("id"), _pick(_CATEGORIES, k).alias("category"), (F.col("o_custkey") * 3 % 2200).alias("case_id"), F.when(k % 4 > 0, F.concat(F.lit("c"), k.cast("string"))).alias("candidate_id"), F.when(k % 5 > 0, 92).otherwise(1).cast("long").alias("line"), _pick(_SEVERITIES, k).alias("severity"), F.when(k % 2 == 0, F.lit(" R1 ")).alias("rule_id"))
    place = part.select(F.col("p_partkey").alias("case_id"), F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit(".py")).alias("path"))
    return feedback.promotions(asked.join(place, "case_id", "left"), corpus, "tables")


_PROMOTED = f"""c as (select p_partkey as case_id, case when p_partkey % 50 > 0 then p_brand else '' end as repository, case when right(p_brand, 1)::int % 3 = 0 then 'holdout' else 'validation' end as split, p_size % 2 as n_expected, p_partkey % 17 > 0 as has_lines, {_PATH} as path from part),
f as (select o_orderkey as id, {_list(_CATEGORIES)}[o_orderkey % 7 + 1] as category, o_custkey * 3 % 2200 as case_id, case when o_orderkey % 4 > 0 then 'c' || o_orderkey else o_orderkey::varchar end as own, o_orderkey % 5 > 0 as placed, lower(trim({_list(_SEVERITIES)}[o_orderkey % 5 + 1])) as severity, case when o_orderkey % 2 = 0 then 'R1' end as rule_id from orders),
p as (select id, category, f.case_id, own, c.path, case when placed then 92 else 1 end as line, severity, rule_id, split, repository, case when category in ('execution_error') then 'unconfirmed-category' when category in ('bad_fix', 'accepted') then 'refused-category' when c.case_id is null then 'unknown-case' when repository = '' then 'unknown-repository' when split = 'holdout' then 'hidden-split'
 when category = 'false_positive' and n_expected > 0 then 'clean-source-has-defects' when category = 'missed_issue' and severity = '' then 'no-severity' when not has_lines then 'no-added-lines' when category = 'missed_issue' and not placed then 'not-an-added-line' when category = 'missed_issue' and severity = 'odd' then 'unknown-severity' end as reason
 from f left join c on c.case_id = f.case_id)"""


@query(f"""with {_PROMOTED} select id, category, case_id, reason, case when reason is null then 'tables-' || category || '-' || own end as name, case when reason is null then split end as split, case when reason is null then repository end as repository,
case when reason is null then case when category = 'missed_issue' then concat_ws(':', path, line, severity, rule_id) else '' end end as expected from p""")
def promoted_feedback(spark, sf):
    """Which pieces of feedback become cases, or why not."""
    out = _promoted(spark, sf)
    shown = F.array_join(F.transform("expected", lambda x: F.concat_ws(":", x["path"], x["line"].cast("string"), x["min_severity"], x["rule_id"])), ",")
    return out.select("id", "category", "case_id", "reason", "name", "split", "repository", shown.alias("expected"))


def _text(column: str) -> F.Column:
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")


@query(f"""with {_PROMOTED}, k as (select * from p where reason is null)
select (select count(*) from k)::bigint as promoted, (select count(*) from p where reason is not null)::bigint as refused, (select count(*) from k where category = 'false_positive')::bigint as clean, (select string_agg(x || '=' || n, ',' order by x) from (select split as x, count(*) as n from k group by x)) as by_split,
(select string_agg(x || '=' || n, ',' order by x) from (select category as x, count(*) as n from k group by x)) as by_category, (select string_agg(x || '=' || n, ',' order by x) from (select reason as x, count(*) as n from p where reason is not null group by x)) as by_reason""")
def promotion_plan(spark, sf):
    """A plan's summary: what is promoted and refused, by split, category and reason."""
    out = feedback.plan_summary(_promoted(spark, sf))
    return out.select("promoted", "refused", "clean", *(_text(f"by_{c}").alias(f"by_{c}") for c in ("split", "category", "reason")))


@query("""with p as (select o_orderkey as at, 'n' || o_custkey as name, o_orderstatus as split, o_orderkey % 2 as diff from orders), e as (select 'n' || c_custkey as name, 'F' as split, 1 as diff from customer where c_custkey % 3 = 0),
h as (select p.*, coalesce(e.split, first_value(p.split) over w) as hs, coalesce(e.diff, first_value(p.diff) over w) as hd, e.name is not null as here, row_number() over w as rn from p left join e using (name) window w as (partition by p.name order by "at"))
select "at", name, case when split <> hs or diff <> hd then 'conflict' when not here and rn = 1 then 'written' else 'existing' end as outcome from h""")
def written_cases(spark, sf):
    """Cases written under immutable names."""
    plan = table(spark, sf, "orders").select(F.col("o_orderkey").alias("at"), F.concat(F.lit("n"), F.col("o_custkey").cast("string")).alias("name"), F.col("o_orderstatus").alias("split"), (F.col("o_orderkey") % 2).alias("diff"))
    existing = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("name"), F.lit("F").alias("split"), F.lit(1).cast("long").alias("diff"))
    return feedback.written(plan, existing, ["split", "diff"]).select("at", "name", "outcome")


_RULES = ("r1", " R1", "r2", "", "R3")
_CAUSES = f"""f as (select o_orderkey as id, {_list(_CATEGORIES)}[o_orderkey % 7 + 1] as category, substr(sha256({_list(_CATEGORIES)}[o_orderkey % 7 + 1] || chr(31) || upper(trim({_list(_RULES)}[o_custkey % 5 + 1])) || chr(31) || 'src/f' || o_custkey % 40 || '.py'), 1, 16) as cause, o_orderkey, o_custkey from orders),
a as (select id, cause, o_custkey % 6 as run_id, o_orderkey % 2 as baseline from f where o_orderkey % 7 = 3 or o_orderkey % 11 = 0)"""


def _feedback(spark, sf) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, sf, "orders").select(k.alias("id"), _pick(_CATEGORIES, k).alias("category"), _pick(_RULES, c).alias("rule"), F.format_string("./SRC//x/../f%d.py", c % 40).alias("path"), c.alias("cust"))
    return rows.withColumn("cause", feedback.cause(F.col("category"), F.col("rule"), F.col("path")))


def _attempts(spark, sf) -> DataFrame:
    return _feedback(spark, sf).where("id % 7 = 3 or id % 11 = 0").select("id", F.col("id").alias("row"), "cause", (F.col("cust") % 6).alias("run_id"), (F.col("id") % 2).alias("baseline"))


@query(f"""with {_CAUSES}, s as (select cause, count(*) as n from f where category in ('false_positive', 'missed_issue', 'bad_fix', 'accepted') group by all), r as (select cause, count(distinct run_id) as n from a group by all)
select id, category, f.cause, case when category = 'execution_error' then 'inferred' when id in (select id from a) then 'attempted' when coalesce(r.n, 0) >= 5 then 'exhausted' when coalesce(s.n, 0) >= 3 then 'selected' else 'sporadic' end as fate from f left join s on s.cause = f.cause left join r on r.cause = f.cause""")
def triaged_feedback(spark, sf):
    """What is learned from in this round, and why the rest isn't."""
    return feedback.triaged(_feedback(spark, sf).select("id", "category", "cause"), _attempts(spark, sf), 3, 5)


@query(f"""with {_CAUSES}, t as (select cause, count(distinct run_id) as tries from a group by all), k as (select distinct cause from f where category = 'missed_issue'), r as (select a.id as row, a.cause, run_id, tries from a join t on t.cause = a.cause where baseline = 1 and a.cause in (select cause from k))
select row, cause, run_id, tries, row_number() over (order by tries desc, row desc) as place, (select count(*) from r) as considered from r order by tries desc, row desc limit 25""")
def reflection_attempts(spark, sf):
    """The attempts on this round's causes and baseline that a generator is told of: 25 of those considered (a top-k report)."""
    causes = _feedback(spark, sf).where("category = 'missed_issue'")
    out = feedback.prior_attempts(_attempts(spark, sf), causes, F.lit(1), 25)
    return out.select("row", "cause", "run_id", "tries", "place", "considered")


_TEXTS = ("eval(x)", " eval(y) ", "", "a\nb", "os.system(c)")


def _told(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(k.alias("at"), _pick(_CATEGORIES, k).alias("category"), F.when(k % 13 > 0, F.format_string(" rule-%d", F.col("o_custkey") % 200)).alias("rule_id"), _pick(_TEXTS, F.expr("o_orderkey div 7")).alias("evidence"), _pick(("low", "HIGH"), k).alias("severity"))


_LEARNED = f"""with recursive e as (select o_orderkey as k, {_list(_CATEGORIES)}[o_orderkey % 7 + 1] as category, 'RULE-' || o_custkey % 200 as rule, o_orderkey % 13 > 0 as named, ['eval(x)', 'eval(y)', '', 'no', 'os.system(c)'][o_orderkey // 7 % 5 + 1] as match from orders),
u as (select *, case when named and category = 'missed_issue' and match not in ('', 'no') then 'add' when named and category = 'false_positive' then 'remove' end as kind from e),
q as (select *, row_number() over (partition by rule order by k) as rn from u where kind is not null),
s as (select rule, 0::bigint as rn, null::bigint as k, case when i % 4 = 0 then ['eval(x)'] else []::varchar[] end as held, '' as outcome from (select distinct rule, substr(rule, 6)::int as i from q) union all
select s.rule, q.rn, q.k, case when q.kind = 'remove' then [] when list_contains(s.held, q.match) then s.held else list_append(s.held, q.match) end, case when q.kind = 'remove' then case when len(s.held) > 0 then 'removed' else 'nothing-to-remove' end when list_contains(s.held, q.match) then 'known' else 'added' end from s join q on q.rule = s.rule and q.rn = s.rn + 1)"""


@query(f"""{_LEARNED}, t as (select rule, arg_max(held, rn) as held from s group by rule union all select 'RULE-' || i, ['eval(x)'] from range(0, 200, 4) r(i) where 'RULE-' || i not in (select rule from s))
select 'rule' as what, rule as rule_id, unnest(held) as of, 1::bigint as n from t union all select 'outcome', null, outcome, count(*)::bigint from s where k is not null group by outcome union all select 'outcome', null, 'ignored', count(*)::bigint from u where kind is null""")
def learned_literals(spark, sf):
    """Rules after all feedback, and how often each thing happened; every fourth rule has a literal before."""
    rules = spark.range(0, 200, 4).select(F.format_string("RULE-%d", "id").alias("rule_id"), F.lit("eval(x)").alias("match"), F.lit("high").alias("severity"))
    after, told = learned_rules(rules, _told(spark, sf))
    by = told.groupBy("outcome").agg(F.count("*").alias("n"))
    return after.select(F.lit("rule").alias("what"), "rule_id", F.col("match").alias("of"), F.lit(1).cast("long").alias("n")).unionByName(by.select(F.lit("outcome").alias("what"), F.lit(None).cast("string").alias("rule_id"), F.col("outcome").alias("of"), "n"))


@query("""with r as (select o_orderkey as id, o_custkey as task, o_orderstatus as scope, o_orderkey as created, case when o_orderkey % 3 = 0 then o_orderkey % 20000 end as expires from orders),
n as (select o_orderkey + 500 as seen, case when o_orderkey % 2 = 0 then o_custkey end as task, case when o_orderkey % 2 = 1 and o_orderkey % 5000 < 30 or o_orderkey % 8 = 0 then o_orderstatus end as scope from orders where o_orderkey % 40 = 1 or o_orderkey % 16 = 0)
select id from r where not exists (select 1 from n where (n.task is not null or n.scope is not null) and n.seen >= r.created and (n.task is null or n.task = r.task) and (n.scope is null or n.scope = r.scope)) and (expires is null or expires > 9000)""")
def rows_not_deleted(spark, sf):
    """Rows that no later deletion by task, by scope or by both covers, and that haven't expired."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders")
    held = o.select(k.alias("id"), F.col("o_custkey").alias("task"), F.col("o_orderstatus").alias("scope"), k.alias("created"), F.when(k % 3 == 0, k % 20000).alias("expires"))
    notices = o.where("o_orderkey % 40 = 1 or o_orderkey % 16 = 0").select((k + 500).alias("at"), F.when(k % 2 == 0, F.col("o_custkey")).alias("task"), F.when((k % 2 == 1) & (k % 5000 < 30) | (k % 8 == 0), F.col("o_orderstatus")).alias("scope")).where("task is not null or scope is not null")
    return without_deleted(held, notices, ["task", "scope"], F.lit(9000)).select("id")
