"""Replays and their checkpoints, labels of two rounds, recall of memories, excerpts, worksheets and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlytics.functions.strings import strip
from revlytics.functions.metrics import ratio
from revlytics.operators import matching
from revlytics.operators.diffs import lines_of
from revlytics.plans.corpus import _PATH, _diffs
from revlytics.plans.registry import query, table
from revlytics.plans.scoring import _REVIEWED, _memories, _reviewed, tier_edges

# Labels that a rater could give with the evidence at hand.
JUDGEABLE = ("valid", "invalid")


def paired_rounds(one: DataFrame, two: DataFrame) -> DataFrame:
    """id, a, b of two rounds (id, label); null on the side that lacks the id."""
    return one.select("id", F.col("label").alias("a")).join(two.select("id", F.col("label").alias("b")), "id", "full")


def retested(pairs: DataFrame) -> DataFrame:
    """One row: pairs and unpaired ids, raw agreement and kappa, agreement where both could judge, and each round's share of valid ones among the judged."""
    both, a, b = F.expr("a is not null and b is not null"), F.col("a"), F.col("b")
    judged = a.isin(*JUDGEABLE) & b.isin(*JUDGEABLE)
    labels = (*JUDGEABLE, "unlabelled")
    counts = [F.count_if(both & (c == v)).alias(f"{n}_{v}") for n, c in (("a", a), ("b", b)) for v in labels]
    total = pairs.agg(F.count_if(both).alias("paired"), F.count_if(~both).alias("unpaired"), F.count_if(a == b).alias("same"), F.count_if(judged).alias("judgeable"), F.count_if(judged & (a == b)).alias("judged_same"), *counts)
    n = F.col("paired").cast("double")
    by_chance = F.try_divide(sum((F.col(f"a_{v}").cast("double") * F.col(f"b_{v}") for v in labels), F.lit(0.0)), n * n)
    kappa = F.when(by_chance < 1, F.round((F.try_divide(F.col("same").cast("double"), n) - by_chance) / (1 - by_chance), 4))
    rate = lambda s: ratio(F.col(f"{s}_valid"), F.col(f"{s}_valid") + F.col(f"{s}_invalid"))
    return total.select("paired", "unpaired", ratio(F.col("same"), F.col("paired")).alias("agreement"), kappa.alias("kappa"), "judgeable", ratio(F.col("judged_same"), F.col("judgeable")).alias("judged_agreement"), rate("a").alias("rate_one"), rate("b").alias("rate_two"))


@query("""with p as (select a, b from (select doc_id, case when doc_id % 5 = 0 then 'unlabelled' when quality = 1 then 'valid' else 'invalid' end as a from labels where doc_id % 13 <> 0)
full join (select doc_id, case when doc_id % 7 = 0 then 'unlabelled' when toxic = 0 then 'valid' else 'invalid' end as b from labels where doc_id % 17 <> 0) using (doc_id)),
q as (select *, a <> 'unlabelled' and b <> 'unlabelled' as j from p where a is not null and b is not null), n as (select count(*)::double as n from q),
e as (select sum(x.c * y.c) / any_value(n.n * n.n) as pe from (select a as v, count(*)::double as c from q group by a) x join (select b as v, count(*)::double as c from q group by b) y using (v), n)
select count(*)::bigint as paired, (select count(*) from p where a is null or b is null)::bigint as unpaired, round(count_if(a = b)::double / count(*), 4) as agreement, round((count_if(a = b)::double / count(*) - any_value(pe)) / (1 - any_value(pe)), 4) as kappa,
count_if(j)::bigint as judgeable, round(count_if(j and a = b)::double / count_if(j), 4) as judged_agreement, round(count_if(a = 'valid')::double / count_if(a <> 'unlabelled'), 4) as rate_one, round(count_if(b = 'valid')::double / count_if(b <> 'unlabelled'), 4) as rate_two from q, e""")
def retest_summary(spark, sf):
    """Test and retest of labels: unpaired ids are counted, not dropped in silence."""
    rows = table(spark, sf, "labels")
    label = lambda k, good: F.when(F.col("doc_id") % k == 0, "unlabelled").when(good, "valid").otherwise("invalid").alias("label")
    one = rows.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("id"), label(5, F.col("quality") == 1))
    two = rows.where("doc_id % 17 <> 0").select(F.col("doc_id").alias("id"), label(7, F.col("toxic") == 0))
    return retested(paired_rounds(one, two))


def candidates(found: DataFrame, truth: DataFrame, replay: DataFrame, tolerance: int, tier: str) -> DataFrame:
    """case_id, kind, item of truths nobody found and findings without a truth, of the cases in replay(case_id, error).

    A case that ended in an error, or wasn't replayed, gives none: it is not a case without findings.
    """
    ran = replay.where("error is null").select("case_id")
    found, truth = found.join(ran, "case_id", "left_semi"), truth.join(ran, "case_id", "left_semi")
    matched = matching.match(tier_edges(found, truth, tolerance).where(tier), "case_id", matching.max_matching)
    missed = truth.join(matched, ["case_id", "t"], "left_anti").select("case_id", F.lit("expected").alias("kind"), F.col("t").alias("item"))
    return missed.unionByName(found.join(matched, ["case_id", "p"], "left_anti").select("case_id", F.lit("finding").alias("kind"), F.col("p").alias("item")))


@query(f"""with {_REVIEWED}, c as (select case_id, n, count_if(truth) as e, count_if(not truth) as f from k where case_id % 10 < 8 and case_id % 11 <> 0 group by case_id, line, n),
s as (select case_id, sum(e - least(e, f)) as e, sum(f - least(e, f)) as f from c group by case_id)
select case_id, 'expected' as kind, e::bigint as n from s where e > 0 union all select case_id, 'finding', f::bigint from s where f > 0""")
def replay_candidates(spark, sf):
    """What people are to judge, by case: only cases of one split whose replay ended."""
    found, truth = _reviewed(spark, sf)
    cases = table(spark, sf, "orders").where("o_orderkey % 10 < 8").select(F.col("o_orderkey").alias("case_id"), F.when(F.col("o_orderkey") % 11 == 0, "timeout").alias("error"))
    return candidates(found, truth, cases, 0, "exact").groupBy("case_id", "kind").agg(F.count("*").alias("n"))


def checkpoint_key(*parts: Column) -> Column:
    """SHA-256 of parts with a NUL between them, so that no two lists of parts meet."""
    return F.sha2(F.concat_ws("\0", *parts), 256)


def latest_of_run(log: DataFrame, fingerprint: str) -> DataFrame:
    """The last record of each key under one configuration; records of others stay in the log but don't count."""
    own = log.where(F.col("fingerprint") == fingerprint)
    return own.groupBy("key").agg(F.max_by("value", "at").alias("value"), F.count("*").alias("records"))


@query("""select sha256('v1' || chr(0) || o_custkey::varchar || chr(0) || o_orderpriority) as key, arg_max(o_orderstatus, o_orderkey) as value, count(*)::bigint as records from orders where o_orderkey % 3 <> 0 group by all""")
def checkpoint_state(spark, sf):
    o = table(spark, sf, "orders")
    key = checkpoint_key(F.lit("v1"), F.col("o_custkey").cast("string"), F.col("o_orderpriority"))
    log = o.select(F.when(F.col("o_orderkey") % 3 == 0, "old").otherwise("now").alias("fingerprint"), key.alias("key"), F.col("o_orderstatus").alias("value"), F.col("o_orderkey").alias("at"))
    return latest_of_run(log, "now")


def replayed(asked: DataFrame, cache: DataFrame, key: str, value: str) -> DataFrame:
    """asked with the cache's value; a key that the cache lacks ends the job: it is not an empty answer."""
    held = cache.select(key, F.struct(value).alias("_held"))
    out = asked.join(held, key, "left")
    missing = F.raise_error(F.concat(F.lit("not in the replay cache: "), F.col(key).cast("string"))).cast(cache.schema[value].dataType)
    return out.withColumn(value, F.when(F.col("_held").isNull(), missing).otherwise(F.col(f"_held.{value}"))).drop("_held")


@query("select o_orderkey, o_custkey, c_mktsegment from orders join customer on o_custkey = c_custkey")
def replay_from_cache(spark, sf):
    asked = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    cache = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return replayed(asked, cache, "o_custkey", "c_mktsegment")


def excerpt(diff: Column, content: Column, span: int) -> Column:
    """The lines around the first added line with that content, `span` on both sides; around the first line of the diff where there is none."""
    lines = lines_of(diff)
    centre = F.greatest(F.coalesce(F.array_position(lines, F.concat(F.lit("+"), content)), F.lit(0)) - 1, F.lit(0))
    first = F.greatest(centre - span, F.lit(0))
    return F.array_join(F.slice(lines, (first + 1).cast("int"), (centre + span + 1 - first).cast("int")), "\n")


@query(f"""select p_partkey as case_id, '@@ -' || p_size || ',3 +' || p_size || ',4 @@' || chr(10) || ' head' || chr(10) || '-old ' || p_name || chr(10) || '+new ' || p_name || chr(10) || '+type ' || p_type || chr(10) || ' tail' || chr(10) || '@@ -90 +91,2 @@' as around,
'diff --git a/' || f || ' b/' || f || chr(10) || 'index 1a2b..3c4d 100644' || chr(10) || '--- a/' || f || chr(10) || '+++ b/' || f as nowhere from (select *, {_PATH} as f from part)""")
def diff_excerpts(spark, sf):
    """Excerpts around an added line, and where the line isn't one."""
    names = table(spark, sf, "part").select(F.col("p_partkey").alias("case_id"), F.concat(F.lit("new "), F.col("p_name")).alias("content"))
    rows = _diffs(spark, sf).join(names, "case_id")
    return rows.select("case_id", excerpt(F.col("diff"), F.col("content"), 3).alias("around"), excerpt(F.col("diff"), F.lit("none"), 3).alias("nowhere"))


def recalled(asked: DataFrame, memories: DataFrame, pool: int, most: int) -> DataFrame:
    """asked(ask, repository, text) with the `most` best of the `pool` latest memories of its repository.

    0.55 of the query's tokens covered, 0.15 of the memory's, 0.25 of importance and 0.05 by place in the pool. One that shares nothing is left out
    unless it is semantic. The pool is cut before the join, so a query meets `pool` rows at most; the group limit runs before the shuffle.
    """
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_./:-]{2,}"), F.lit(0)))
    latest = Window.partitionBy("repository").orderBy(F.desc("created"), "id")
    held = memories.withColumn("place", F.row_number().over(latest)).where(F.col("place") <= pool)
    held = held.select("repository", "id", "scope", "importance", "created", "place", tokens(F.concat_ws(" ", "content", "kind")).alias("m"))
    both = asked.select("ask", "repository", tokens(F.col("text")).alias("q")).join(held, "repository")
    shared = F.size(F.array_intersect("q", "m"))
    score = F.round(0.55 * shared / F.greatest(F.size("q"), F.lit(1)) + 0.15 * shared / F.greatest(F.size("m"), F.lit(1)) + 0.25 * F.col("importance") + F.lit(0.05) / F.col("place"), 4)
    kept = both.where((F.size("q") == 0) | (shared > 0) | (F.col("scope") == "semantic")).withColumn("score", score)
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "created", "id")
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).select("ask", "id", "score", F.col("rank").cast("long").alias("rank"))


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9_./:-]{{2,}}'))"


@query(f"""with r as (select p_brand as repository, ['semantic', 'episodic', 'working', 'semantic'][p_partkey % 4 + 1] as scope, p_type as kind, trim(' ' || p_name || ' ' || p_type) as content, greatest(0.0::double, least(1.0::double, p_size / 40)) as importance, p_partkey as created from part),
m as (select sha256('{{"content":"' || content || '","kind":"' || kind || '","repository":"' || repository || '","scope":"' || scope || '","tenant":"t"}}') as id, * from r), u as (select * from m qualify row_number() over (partition by id order by created desc) = 1),
h as (select *, row_number() over (partition by repository order by created desc, id) as place, {_WORDS.format("content || ' ' || kind")} as w from u qualify place <= 200),
b as (select p_partkey as ask, id, scope, created, importance, place, w, {_WORDS.format('p_name')} as q, len(list_intersect(q, w)) as shared from part join h on p_brand = repository where p_partkey % 100 = 0),
s as (select ask, id, created, round(0.55 * shared / greatest(len(q), 1) + 0.15 * shared / greatest(len(w), 1) + 0.25 * importance + 0.05::double / place, 4) as score from b where len(q) = 0 or shared > 0 or scope = 'semantic')
select ask, id, score::double as score, row_number() over (partition by ask order by score desc, created, id)::bigint as rank from s qualify rank <= 5""")
def recall_scores(spark, sf):
    """Memories recalled for every part whose key is divisible by 100."""
    asked = table(spark, sf, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("ask"), F.col("p_brand").alias("repository"), F.col("p_name").alias("text"))
    return recalled(asked, _memories(spark, sf), 200, 5)


def worksheet_records(sheets: DataFrame, sheet: str, text: str, opens: str = "candidate_id") -> DataFrame:
    """sheet, record, id, fields, repeated of `key: value` lines; a line with the opening key starts a record, of a key said twice the last value counts.

    Lines before the first record make record 0, without an id: orphans. `repeated`: the sheet has the id in another record as well.
    """
    pair = r"^([A-Za-z_]+):[ \t]*(.*)$"
    lines = sheets.select(sheet, F.posexplode(lines_of(F.col(text))).alias("at", "raw")).where(F.col("raw").rlike(pair))
    lines = lines.select(sheet, "at", F.regexp_extract("raw", pair, 1).alias("k"), strip(F.regexp_extract("raw", pair, 2)).alias("v"))
    so_far = Window.partitionBy(sheet).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("record", F.count_if(F.col("k") == opens).over(so_far))
    last = placed.groupBy(sheet, "record", "k").agg(F.max_by("v", "at").alias("v"))
    rows = last.groupBy(sheet, "record").agg(F.max(F.when(F.col("k") == opens, F.col("v"))).alias("id"), F.sort_array(F.collect_list(F.when(F.col("k") != opens, F.concat_ws("=", "k", "v")))).alias("fields"))
    many = F.count("*").over(Window.partitionBy(sheet, "id"))
    return rows.select(sheet, "record", "id", F.array_join("fields", ";").alias("fields"), (F.col("id").isNotNull() & (many > 1)).alias("repeated"))


@query("""select p_partkey as sheet, unnest([0, 1, 2])::bigint as record, unnest([null, 'c' || p_size, case when p_partkey % 2 = 0 then 'c' || p_size else 'd' end]) as id, unnest(['note=lost', 'label=no;note=' || p_type, 'label=yes']) as fields,
unnest([false, p_partkey % 2 = 0, p_partkey % 2 = 0]) as repeated from part""")
def parsed_worksheets(spark, sf):
    text = F.concat_ws("\n", F.lit("note: lost\n# heading"), F.format_string("candidate_id: c%d\nlabel: yes\nlabel:  no", "p_size"), F.concat(F.lit("note: "), F.col("p_type")), F.when(F.col("p_partkey") % 2 == 0, F.format_string("candidate_id: c%d", "p_size")).otherwise("candidate_id: d"), F.lit("label: yes\n"))
    return worksheet_records(table(spark, sf, "part").select(F.col("p_partkey").alias("sheet"), text.alias("text")), "sheet", "text")


def exposition(totals: DataFrame, name: str, label: str, count: str, seconds: str) -> DataFrame:
    """line: counters and duration sums and counts in the text format of metric scrapers, three lines a label."""
    tag = F.concat(F.lit("{" + label + '="'), F.replace(F.replace(label, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"} '))
    line = lambda suffix, c: F.concat(F.lit(f"{name}_{suffix}"), tag, F.col(c).cast("string"))
    return totals.select(F.explode(F.array(line("total", count), line("seconds_sum", seconds), line("seconds_count", count))).alias("line"))


@query("""with t as (select l_returnflag as f, count(*)::bigint as n, sum(l_linenumber)::bigint as s from lineitem group by all) select 'steps_total{flag="' || f || '"} ' || n as line from t union all select 'steps_seconds_sum{flag="' || f || '"} ' || s from t union all select 'steps_seconds_count{flag="' || f || '"} ' || n from t""")
def metric_lines(spark, sf):
    totals = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.sum(F.col("l_linenumber").cast("long")).alias("s"))
    return exposition(totals, "steps", "flag", "n", "s")


def markdown_row(*cells: Column) -> Column:
    """A table row; bars are escaped, null is a dash."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.replace(c.cast("string"), F.lit("|"), F.lit("\\|")), F.lit("-")) for c in cells)), F.lit(" |"))


@query("""select lang, '| ' || coalesce(lang || '\\|x', '-') || ' | ' || count(*) || ' | ' || count_if(n_chars > 1000) || ' |' as row from documents group by lang""")
def markdown_rows(spark, sf):
    counts = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long"))
    return counts.select("lang", markdown_row(F.concat("lang", F.lit("|x")), F.col("n"), F.col("long")).alias("row"))


@query("""select l_suppkey as place, l_shipmode as rule, l_orderkey as kept_order, l_linenumber::bigint as kept_line, l_discount as confidence from (select *, l_returnflag as l_shipmode from lineitem) qualify row_number() over (partition by l_suppkey, l_shipmode order by l_discount desc, l_orderkey, l_linenumber) = 1""")
def best_findings(spark, sf):
    """Of findings of a rule at a place the surest stays, the first of equals; partial maxima, no window."""
    first = F.min_by(F.struct("l_orderkey", "l_linenumber", "l_discount"), F.struct((-F.col("l_discount")).alias("d"), "l_orderkey", "l_linenumber"))
    best = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("place"), F.col("l_returnflag").alias("rule")).agg(first.alias("b"))
    return best.select("place", "rule", F.col("b.l_orderkey").alias("kept_order"), F.col("b.l_linenumber").cast("long").alias("kept_line"), F.col("b.l_discount").alias("confidence"))


@query("""select c_custkey, o_orderkey, o_orderstatus from customer left join (select * from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1) on o_custkey = c_custkey""")
def latest_runs(spark, sf):
    """Every version with its latest run, those without one too."""
    runs = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("r"))
    return table(spark, sf, "customer").select("c_custkey").join(runs, "c_custkey", "left").select("c_custkey", "r.o_orderkey", "r.o_orderstatus")
