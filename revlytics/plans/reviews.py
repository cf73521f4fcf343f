"""Rule scans over lines that the tables make."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlytics.operators import lookup, scanners
from revlytics.plans.registry import query, table

#: Lines of code; {} is a number. Some break rules, some nearly do.
_CODE = (
    "x = eval(v{})", "retrieval(v{})", "run(cmd{}, shell = True)", "run(cmd, shell=Trueish{})", "api_key = 'k{}-abcdef'", "Token{} = 'abcdef'", "SECRET = \"s{}xyz\"", "password = ''", "db.execute(f\"select {}\")",
    "db.Query( 'a{}' % b)", "db.execute('select {}')", "  except Exception: pass", "except Exception as e{}:", "print (v{})", "console.log(v{})", "fingerprint(v{})", "open(base / user_path)", "yaml.load (f{})", "yaml.safe_load(f{})",
    "hashlib.md5(b{})", "  while True:  # {}", "assert user.is_admin", "r.set_cookie(k{}, secure = False)", "r.set_cookie(k{}, secure=True)", "random.random()", "# TODO: {}", "# TODOS {}", "tempfile.mktemp({})", "plain {}",
)
_PATHS = ("src/a{}.py", "tests/t{}.py", "web/app{}.min.js", "poetry.lock", "web/a{}.js", "src/tests/{}.py")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _pick(values: tuple, k, number):
    return F.replace(F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int")), F.lit("{}"), number.cast("string"))


def _lines(spark, sf) -> DataFrame:
    k = F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), _pick(_PATHS, F.col("l_suppkey"), F.col("l_suppkey") % 3).alias("path"), F.col("l_linenumber").cast("long").alias("line"), _pick(_CODE, k, F.col("l_partkey") % 50).alias("content"))


_SQL_LINES = f"""l as (select l_orderkey as case_id, replace([{", ".join(map(_quoted, _PATHS))}][l_suppkey % {len(_PATHS)} + 1], '{{}}', (l_suppkey % 3)::varchar) as path, l_linenumber::bigint as line,
replace([{", ".join(map(_quoted, _CODE))}][(l_partkey + l_suppkey + l_linenumber) % {len(_CODE)} + 1], '{{}}', (l_partkey % 50)::varchar) as content from lineitem)"""


def _by_rule(rules: tuple, where: str) -> str:
    return " union all ".join(f"select *, '{r}' as rule_id, '{s}' as severity from l where regexp_matches(content, {_quoted(p)}) and {where.format(rule=r)}" for r, s, p in rules)


_GENERATED = "not (ends_with(path, '.lock') or ends_with(path, '.min.js') or ends_with(path, '.map'))"
#: Rules that a case's prompt switches on.
_FOCUS = tuple(r for r, _, _ in scanners.EXTRA_RULES)


@query(f"""with {_SQL_LINES}, f as ({_by_rule(scanners.LINE_RULES, _GENERATED)} union all {_by_rule(scanners.EXTRA_RULES, f"'{{rule}}' in ({', '.join(map(_quoted, _FOCUS))}) and '{{rule}}' = [{', '.join(map(_quoted, _FOCUS))}][case_id % 9 + 1]")} union all {_by_rule(scanners.UNFINISHED_RULES, "not starts_with(path, 'tests/')")}),
d as (select case_id, rule_id, path, line, min(content) as content, any_value(severity) as severity from f group by all)
select rule_id, severity, count(*)::bigint as findings, count(distinct case_id)::bigint as cases, min(substr(trim(content), 1, 240)) as evidence, min('local-rule:' || substr(sha256(rule_id || path || line || content), 1, 16)) as least_id from d group by all""")
def review_findings(spark, sf):
    """Every rule set over every added line: line rules, supplemental rules that a case's prompt names, unfinished code; a finding once for a rule and line."""
    lines = _lines(spark, sf)
    named = F.get(F.array(*map(F.lit, _FOCUS)), (F.col("case_id") % 9).cast("int"))
    prompt = F.concat(F.lit("Look closely. [focus-rule:"), F.coalesce(named, F.lit("NO-SUCH-RULE")), F.lit("] [other:SEC-EVAL]"))
    found = scanners.policy_findings(lines, scanners.switched_on(prompt)).unionByName(scanners.scanned(lines, scanners.UNFINISHED_RULES, scanners.UNFINISHED_CONFIDENCE, (), scanners.TEST_PREFIXES))
    found = scanners.first_findings(found, "case_id", "content")
    least = F.min(scanners.evidence_id(F.col("rule_id"), F.col("path"), F.col("line"), F.col("content"))).alias("least_id")
    by_case = found.groupBy("rule_id", "severity", "case_id").agg(F.count("*").alias("n"), F.min("evidence").alias("evidence"), least)
    return by_case.groupBy("rule_id", "severity").agg(F.sum("n").alias("findings"), F.count("*").alias("cases"), F.min("evidence").alias("evidence"), F.min("least_id").alias("least_id"))


#: An artifact's rules as data.
ARTIFACT = scanners.checked_rules([
    {"rule_id": "lit-secret", "match": "password", "severity": "high", "ignore_case": True, "exclude_paths": []}, {"rule_id": "LIT-SECRET", "match": "secret", "severity": "critical", "exclude_paths": ["src/src12"]},
    {"rule_id": "LIT-MAIL", "match": "@", "exclude_paths": ["src/src1", "src/src5/"]}, {"rule_id": "LIT-KEY", "match": "AKIA", "severity": "critical"}, {"rule_id": "LIT-AND", "match": " AND ", "ignore_case": True, "include_paths": ["src/src1", "src/src7/"]},
    {"rule_id": "LIT-TION", "match": "tion", "severity": "low", "exclude_paths": []}, {"rule_id": "LIT-UND", "match": "und ", "severity": "low", "include_paths": ["src/src1"], "exclude_paths": ["src/src10/"]}, {"rule_id": "LIT-ACUTE", "match": "é", "severity": "low"},
    {"rule_id": "LIT-CAPITAL", "match": "ÉTI", "ignore_case": True}, {"rule_id": "LIT-DIGITS", "match": "00", "severity": "low"}, {"rule_id": "LIT-LICENSE", "match": "licensed under the", "ignore_case": True, "severity": "medium"}, {"rule_id": "LIT-NEVER", "match": "no such text anywhere"},
])


def _artifact_sql() -> str:
    text = lambda r: (f"lower(content), lower({_quoted(r['match'])})" if r["ignore_case"] else f"content, {_quoted(r['match'])}")
    any_of = lambda prefixes: "(" + " or ".join(f"starts_with(path, {_quoted(p)})" for p in prefixes) + ")"
    paths = lambda r: " and ".join(["true", *([any_of(r["include_paths"])] if r["include_paths"] else []), *(["not " + any_of(r["exclude_paths"])] if r["exclude_paths"] else [])])
    return " union all ".join(f"select doc_id, line, '{r['rule_id']}' as rule_id, {i} as i, '{r['severity']}' as severity from l where contains({text(r)}) and {paths(r)}" for i, r in enumerate(ARTIFACT))


@query(f"""with l as (select doc_id, 'src/' || coalesce(source, '') || '/' || doc_id as path, unnest(range(1, len(s) + 1)) as line, unnest(s) as content from (select *, string_split(text, chr(10)) as s from documents)),
f as (select doc_id, line, rule_id, arg_min(severity, i) as severity from ({_artifact_sql()}) group by all) select rule_id, severity, count(*)::bigint as findings, count(distinct doc_id)::bigint as documents from f group by all""")
def literal_rule_findings(spark, sf):
    """An artifact of literal rules over every line of every document, in one pass."""
    docs = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("src/"), F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    found = scanners.literal_findings(docs, ARTIFACT).groupBy("rule_id", "severity", "doc_id").agg(F.count("*").alias("n"))
    return found.groupBy("rule_id", "severity").agg(F.sum("n").alias("findings"), F.count("*").alias("documents"))


@query("""with l as (select doc_id, unnest(range(1, len(s) + 1)) as line, unnest(s) as content from (select doc_id, string_split(text, chr(10)) as s from documents)), h as (select *, row_number() over (partition by doc_id order by line) as n from l where contains(lower(content), 'the'))
select doc_id, line, substr(content, 1, 500) as content from h where n <= 3""")
def searched_lines(spark, sf):
    """The first three lines of every document that hold a text, in any case."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("at", "content")).select("doc_id", (F.col("at") + 1).cast("long").alias("line"), "content")
    return lookup.searched(lines, "THE", ["doc_id"], 3)


@query("""with d as (select doc_id, string_split(text, chr(10)) as s, ends_with(text, chr(10)) as closed, greatest(1, doc_id % 6 - 1) as a, doc_id % 9 as b from documents where text is not null),
r as (select *, least(greatest(a, b), a + 499) as h, case when text_empty then 0 when closed then len(s) - 1 else len(s) end as n from (select *, len(s) = 1 and s[1] = '' as text_empty from d))
select doc_id, a::bigint as start_line, least(h, n)::bigint as end_line, substr(array_to_string(s[a:least(h, n)], chr(10)) || case when least(h, n) >= a and (h < n or closed) then chr(10) else '' end, 1, 40000) as content from r""")
def line_ranges(spark, sf):
    """A range of lines of every document, clamped to it."""
    k = F.col("doc_id")
    r = lookup.read_range(F.col("text"), k % 6 - 1, k % 9)
    return table(spark, sf, "documents").where("text is not null").select("doc_id", r.alias("r")).select("doc_id", "r.*")


@query("""with f as (select s_nationkey as nation, case when s_suppkey % 3 = 0 then 'tests/test_m' || s_suppkey % 10 || '.py' when s_suppkey % 3 = 1 then 'src/m' || s_suppkey % 10 || '.py' else 'spec/Thing' || s_suppkey % 10 || '_spec.rb' end as path from supplier),
g as (select distinct nation, path, lower(path) as low from f where lower(path) like '%test%' or lower(path) like '%spec%'), q as (select n_nationkey as nation, case n_nationkey % 3 when 0 then 'src/m' || n_nationkey % 10 || '.py' end as path, case when n_nationkey % 3 < 2 then 'Thing' || n_nationkey % 5 end as symbol from nation),
t as (select nation, list_distinct(list_filter([lower(symbol), case when path is not null then 'm' || nation % 10 end, case when path is not null then 'test_m' || nation % 10 end], lambda x: x is not null)) as tokens from q),
r as (select t.nation, g.path, len(list_filter(tokens, lambda x: contains(low, x))) as relevance, len(tokens) as n from t join g using (nation))
select nation, nation as ask, path, relevance::int as relevance from r where relevance > 0 or n = 0""")
def located_tests(spark, sf):
    """Test files that belong to each nation's question."""
    k, s = F.col("n_nationkey"), F.col("s_suppkey")
    m = (s % 10).cast("string")
    path = F.when(s % 3 == 0, F.concat(F.lit("tests/test_m"), m, F.lit(".py"))).when(s % 3 == 1, F.concat(F.lit("src/m"), m, F.lit(".py"))).otherwise(F.concat(F.lit("spec/Thing"), m, F.lit("_spec.rb")))
    files = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"), path.alias("path")).distinct()
    asked = table(spark, sf, "nation").select(k.alias("nation"), k.alias("ask"), F.when(k % 3 == 0, F.concat(F.lit("src/m"), (k % 10).cast("string"), F.lit(".py"))).alias("path"), F.when(k % 3 < 2, F.concat(F.lit("Thing"), (k % 5).cast("string"))).alias("symbol"))
    return lookup.located_tests(asked, files, ["nation"], "ask")
