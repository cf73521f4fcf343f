"""Corpus construction: rule scans, screening, diffs, fingerprints, splits, coverage, sampling, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from revlytics.functions.metrics import bucket
from revlytics.operators import diffs, rules
from revlytics.operators.numbering import hash_order, numbered_by_hash, running
from revlytics.operators.recall import best_covering
from revlytics.plans.registry import query, spread, table

_LINES = "(select doc_id, source, unnest(string_split(text, chr(10))) as content from documents)"
_HITS = " union all ".join(f"select *, '{r}' as rule_id, '{s}' as severity from {_LINES} where regexp_matches(content, '{p.replace(chr(39), chr(39) * 2)}')" for r, s, p in rules.DOCUMENT_RULES)


@query(f"select source, rule_id, severity, count(*)::bigint as findings, count(distinct doc_id)::bigint as documents from ({_HITS}) group by all")
def rule_findings(spark, sf):
    docs = table(spark, sf, "documents")
    found = rules.line_findings(docs.select(F.struct("source", "doc_id").alias("doc"), "text"), "doc").select("doc.source", "doc.doc_id", "rule_id", "severity")
    by_doc = found.groupBy("source", "doc_id", "rule_id", "severity").agg(F.count("*").alias("n"))
    return by_doc.groupBy("source", "rule_id", "severity").agg(F.sum("n").alias("findings"), F.count("*").alias("documents"))


@query(f"""select rule_id, reasons, count(*)::bigint as findings from (select rule_id, concat_ws(',', case when length(content) > 400 then 'too-long' end,
case when not regexp_matches(content, '[A-Za-z]') then 'no-letters' end, case when severity = 'low' then 'low-severity' end, case when trim(content) = '' then 'empty' end) as reasons from ({_HITS})) group by all""")
def finding_gate(spark, sf):
    """All reasons against a finding are kept; accepted is the empty list."""
    c = F.col("content")
    checks = {"too-long": F.length(c) > 400, "no-letters": ~c.rlike("[A-Za-z]"), "low-severity": F.col("severity") == "low", "empty": F.trim(c) == ""}
    reasons = F.concat_ws(",", F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in checks.items()))))
    return rules.line_findings(table(spark, sf, "documents")).groupBy("rule_id", reasons.alias("reasons")).agg(F.count("*").alias("findings"))


@query("""select source, case when text is null or trim(text) = '' then 'empty' when length(text) < 200 then 'short' when regexp_matches(split_part(text, chr(10), 1), '([Ll]icen[sc]e|[Cc]opyright)') then 'license'
when regexp_matches(split_part(text, chr(10), 1), '[0-9]{4}') then 'numbers' when n_chars > 40000 then 'oversized' else 'accepted' end as reason, count(*)::bigint as n from documents group by all""")
def screen_reason_funnel(spark, sf):
    """Ordered screening: the first reason that holds is the row's only one."""
    head = F.split_part("text", F.lit("\n"), F.lit(1))
    reason = (
        F.when(F.col("text").isNull() | (F.trim("text") == ""), "empty").when(F.length("text") < 200, "short").when(head.rlike("([Ll]icen[sc]e|[Cc]opyright)"), "license")
        .when(head.rlike("[0-9]{4}"), "numbers").when(F.col("n_chars") > 40000, "oversized").otherwise("accepted")
    )
    return table(spark, sf, "documents").groupBy("source", reason.alias("reason")).agg(F.count("*").alias("n"))


def _diffs(spark, sf):
    p = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size"), "p_partkey")
    path = F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit(".py"))
    diff = F.format_string(
        "diff --git a/%1$s b/%1$s\nindex 1a2b..3c4d 100644\n--- a/%1$s\n+++ b/%1$s\n@@ -%2$d,3 +%2$d,4 @@\n head\n-old %3$s\n+new %3$s\n+type %4$s\n tail\n@@ -90 +91,2 @@\n end\n+size %2$d\n", path, "p_size", "p_name", "p_type"
    )
    return p.select(F.col("p_partkey").alias("case_id"), diff.alias("diff"))


_PATH = "'src/' || lower(replace(p_brand, '#', '-')) || '.py'"


@query(f"""select p_partkey as case_id, {_PATH} as path, (p_size + 1)::bigint as line, 'new ' || p_name as content from part union all select p_partkey, {_PATH}, (p_size + 2)::bigint, 'type ' || p_type from part
union all select p_partkey, {_PATH}, 92::bigint, 'size ' || p_size from part""")
def diff_added_lines(spark, sf):
    return diffs.added_lines(_diffs(spark, sf))


@query(f"""select p_partkey as case_id, 'diff --git a/' || f || ' b/' || f || chr(10) || '--- a/' || f || chr(10) || '+++ b/' || f || chr(10) || '@@ -' || p_size || ',4 +' || p_size || ',3 @@' || chr(10) || ' head' || chr(10)
|| '+old ' || p_name || chr(10) || '-new ' || p_name || chr(10) || '-type ' || p_type || chr(10) || ' tail' || chr(10) || '@@ -91,2 +90 @@' || chr(10) || ' end' || chr(10) || '-size ' || p_size || chr(10) as reversed
from (select *, {_PATH} as f from part)""")
def diff_reverse(spark, sf):
    return _diffs(spark, sf).select("case_id", diffs.reverse_diff(F.col("diff")).alias("reversed"))


@query("""select l_orderkey as case_id, count(*)::bigint as runs, max(n)::bigint as longest from (select l_orderkey, g, count(*) as n from (select l_orderkey, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as g
from (select distinct l_orderkey, l_linenumber from lineitem)) group by all) group by all""")
def seed_runs(spark, sf):
    """Islands of consecutive line numbers: lines less their rank share a value within a run."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").cast("long").alias("line")).distinct()
    numbered = running(lines, ["case_id"], F.expr("line div 1000000"), [F.col("line")], {"rn": F.lit(1).cast("long")})
    islands = numbered.groupBy("case_id", (F.col("line") - F.col("rn")).alias("g")).agg(F.count("*").alias("n"))
    return islands.groupBy("case_id").agg(F.count("*").alias("runs"), F.max("n").alias("longest"))


@query("""select sha1(array_to_string(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, ' ')), chr(10))) as fingerprint, min(doc_id) as kept, count(*)::bigint as copies from documents where text is not null group by all""")
def content_fingerprint_dedup(spark, sf):
    docs = table(spark, sf, "documents").where("text is not null").select("doc_id", diffs.content_fingerprint(F.col("text")).alias("fingerprint"))
    return docs.groupBy("fingerprint").agg(F.min("doc_id").alias("kept"), F.count("*").alias("copies"))


def _split(source: Column) -> Column:
    return F.when(bucket(source, 10) < 8, "validation").otherwise("holdout")


_SPLIT = "case when ('0x' || substr(sha256(source), 1, 8))::bigint % 10 < 8 then 'validation' else 'holdout' end"


@query(f"""select sha256(text) as content, string_agg(distinct {_SPLIT}, ',' order by {_SPLIT}) as splits, count(*)::bigint as rows_seen from documents where text is not null group by all having count(distinct {_SPLIT}) > 1""")
def split_overlap(spark, sf):
    """Contents that leak from one split to another."""
    docs = table(spark, sf, "documents").where("text is not null").select(F.sha2("text", 256).alias("content"), _split(F.col("source")).alias("split"))
    by = docs.groupBy("content").agg(F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits"), F.count("*").alias("rows_seen"), F.count_distinct("split").alias("n"))
    return by.where("n > 1").drop("n")


@query(f"""with d as (select *, {_SPLIT} as split, case when n_chars < 500 then 'S' when n_chars < 5000 then 'M' else 'L' end as size from documents)
select 'lang' as dim, lang as key, count(*)::bigint as n from d group by lang union all select 'source', source, count(*) from d group by source
union all select 'split', split, count(*) from d group by split union all select 'size', size, count(*) from d group by size""")
def coverage_report(spark, sf):
    """Counters by dimension; the dimensions are unpivoted before one aggregation."""
    size = F.when(F.col("n_chars") < 500, "S").when(F.col("n_chars") < 5000, "M").otherwise("L")
    d = table(spark, sf, "documents").select("lang", "source", _split(F.col("source")).alias("split"), size.alias("size"))
    return d.unpivot([], ["lang", "source", "split", "size"], "dim", "key").groupBy("dim", "key").agg(F.count("*").alias("n"))


@query("""with e(lang, least) as (values ('en', 100), ('fr', 100), ('de', 100), ('es', 100), ('zh', 1)) select e.lang, count(doc_id)::bigint as n, count(doc_id) < any_value(least) as warning from e left join documents d on d.lang = e.lang group by e.lang""")
def coverage_warnings(spark, sf):
    """Every expected class appears, those without rows too."""
    expected = spark.createDataFrame([("en", 100), ("fr", 100), ("de", 100), ("es", 100), ("zh", 1)], "lang string, least long")
    counts = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return expected.join(counts, "lang", "left").select("lang", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) < F.col("least")).alias("warning"))


@query("""select doc_id from documents order by md5('s1|' || doc_id::varchar), doc_id limit 50""")
def hash_sample(spark, sf):
    """A sample of 50 in hash order: independent of arrival, and a larger sample holds a smaller one."""
    return table(spark, sf, "documents").select("doc_id", hash_order("s1", "doc_id").alias("h")).orderBy("h", "doc_id").limit(50).select("doc_id")


def _first(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The first `most` of each key in hash order, with rn: a group limit, which tasks apply before rows are exchanged."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("h", "doc_id"))
    return rows.withColumn("rn", place).where(F.col("rn") <= most)


@query("""select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5('s2|' || doc_id::varchar), doc_id) rn from documents) where rn <= 10""")
def stratified_sample(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", hash_order("s2", "doc_id").alias("h"))
    return _first(docs, "lang", 10).select("doc_id", "lang")


@query("""select doc_id, source from (select doc_id, source, row_number() over (order by rn, md5('repo|' || source), doc_id) as place from (
select doc_id, source, row_number() over (partition by source order by md5('s3|' || doc_id::varchar), doc_id) rn from documents)) where place <= 60""")
def roundrobin_sample(spark, sf):
    """Sources take turns: first by rank within the source, then by the source's hash."""
    docs = table(spark, sf, "documents").select("doc_id", "source", hash_order("s3", "doc_id").alias("h"))
    ranked = _first(docs, "source", 60)
    return ranked.orderBy("rn", hash_order("repo", "source"), "doc_id").limit(60).select("doc_id", "source")


@query("""with r as (select doc_id, lang, row_number() over (partition by lang order by md5('s4|' || doc_id::varchar), doc_id) - 1 as i, count(*) over (partition by lang) as n from documents)
select doc_id, lang from r join (select unnest(range(7)) as k) on i = k * n // 7 where k < n group by all""")
def equidistant_sample(spark, sf):
    """pool[k * n / 7] of each class for k < 7."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", hash_order("s4", "doc_id").alias("h"))
    ranked = numbered_by_hash(docs, ["lang"], "h", "doc_id")
    picks = docs.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.explode(F.array_distinct(F.expr("transform(sequence(0, cast(least(6, n - 1) as int)), k -> k * n div 7 + 1)"))).alias("rn"))
    return ranked.join(picks, ["lang", "rn"]).select("doc_id", "lang")


@query("""with c as (select d.doc_id, (l.toxic = 1) as positive, md5('s5|' || d.doc_id::varchar) as h from documents d join labels l using (doc_id)),
t as (select count(*) as total, count_if(not positive) as clean, count_if(positive) as pos from c), q as (select *, greatest(1, least(clean, floor(40 * least(clean / total, 0.5))))::bigint as c0 from t),
q2 as (select *, greatest(1, least(pos, 40 - c0)) as pq from q), r as (select *, row_number() over (partition by positive order by h, doc_id) as rn from c)
select doc_id, positive from r, q2 where rn <= case when positive then pq else least(c0, pq) end""")
def stratified_select(spark, sf):
    """Two strata with proportional quotas: the clean share at most half, each at least one, clean never over positive."""
    labels = table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 1).alias("positive"))
    cases = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id").withColumn("h", hash_order("s5", "doc_id"))
    n, clean, pos = F.count("*"), F.count_if(~F.col("positive")), F.count_if("positive")
    c0 = F.greatest(F.lit(1), F.least(clean, F.floor(40 * F.least(clean / n, F.lit(0.5)))))
    pq = F.greatest(F.lit(1), F.least(pos, 40 - c0))
    wide = cases.agg(F.array(F.struct(F.lit(True).alias("positive"), pq.alias("quota")), F.struct(F.lit(False).alias("positive"), F.least(c0, pq).alias("quota"))).alias("q"))
    quotas = wide.select(F.inline("q"))
    return _first(cases, "positive", 40).join(quotas, "positive").where("rn <= quota").select("doc_id", "positive")


_TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9_./:-]{2,}'))"


@query(f"""with q as (select item_id, unnest({_TOKENS}) as token, len({_TOKENS}) as size from benchmark), d as (select doc_id, unnest({_TOKENS}) as token from documents),
s as (select item_id, doc_id, count(*) as shared, any_value(size) as size from q join d using (token) group by item_id, doc_id),
r as (select *, row_number() over (partition by item_id order by shared desc, doc_id) as rank from s) select item_id, doc_id, shared::bigint as shared, round(shared::double / size, 4) as coverage from r where rank <= 3""")
def memory_recall(spark, sf):
    """The three documents that cover most of each stated query's tokens; a task sends three documents a query."""
    out = best_covering(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), "text"), 3)
    return out.select(F.col("query").alias("item_id"), F.col("row").alias("doc_id"), "shared", F.round(F.col("shared") / F.col("size"), 4).alias("coverage"))


@query("""select source, count(*)::bigint as kept, max(upto)::bigint as chars from (select source, sum(n_chars) over (partition by source order by md5('b|' || doc_id::varchar), doc_id) as upto from documents) where upto <= 50000 group by source""")
def prefix_budget(spark, sf):
    """Rows in order up to a budget of characters: a true prefix, by running sums."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars", hash_order("b", "doc_id").alias("h"))
    upto = running(docs, ["source"], F.substring("h", 1, 3), [F.col("h"), F.col("doc_id")], {"upto": F.col("n_chars")})
    return upto.where("upto <= 50000").groupBy("source").agg(F.count("*").alias("kept"), F.max("upto").alias("chars"))
