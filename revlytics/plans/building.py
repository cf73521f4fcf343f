"""Cases built from merged changes that the parts' names make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlytics.functions import screening
from revlytics.operators import cases
from revlytics.operators.collecting import collected
from revlytics.plans.registry import query, shared_folder, spread, table

_TITLES = (
    "Fix crash in parser {}", "fix: off-by-one in slice {}", "Add feature {}", "Revert \"fix {}\"", "[3.1{}] fix leak", "Backport fix {}", "v2.{}.1", "2.{}", "Upgrade to 2.{}", "upgrade header {} fixed", "docs: fix {}", "Comment {} broken",
    "style - bug {}", "CVE-2024-1{}23 in reader", "Format {} bug", "Bump x to {}", "Resolve #{} regression", "improve speed {}", "cleanup: fix {}", "Fix clean up {}", "typos fixed {}", "prefixed {}", "Debug {}", "Race condition {}",
)
_BODIES = ("", "This fixes #12.", "closes #{}; see CVE-2023-45678", "plain words", "a security note")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _pick(values: tuple, k, number):
    return F.replace(F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int")), F.lit("{}"), number.cast("string"))


def _sql_pick(values: tuple, k: str, number: str) -> str:
    return f"replace([{', '.join(map(_quoted, values))}][({k}) % {len(values)} + 1], '{{}}', ({number})::varchar)"


def _sql_screen(last: str) -> str:
    hit = lambda column, p: f"regexp_matches({column}, {_quoted(p)})"
    return (
        f"case when {hit('title', screening.BACKPORT_PATTERN)} then 'backport-duplicate' when {hit('title', screening.EXCLUDE_KEYWORDS)} then 'excluded-keyword' when {hit('title', screening.RELEASE_TITLE)} then 'release-commit' "
        f"when {hit('title', screening.DEPENDENCY_UPGRADE)} or {hit('title', screening.SUBJECT_ONLY_PREFIX)} then 'excluded-keyword' {last.format(fix=hit('title || chr(10) || body', screening.FIX_KEYWORDS))} end"
    )


@query(f"""with t as (select p_partkey, {_sql_pick(_TITLES, 'p_partkey', 'p_size')} as title, {_sql_pick(_BODIES, 'p_partkey // 24', 'p_size')} as body from part)
select p_partkey, {_sql_screen("when not {fix} then 'not-a-bugfix'")} as as_fix, {_sql_screen("when {fix} then 'looks-like-a-bugfix'")} as as_clean,
case when regexp_matches(title || chr(10) || body, {_quoted(screening.CVE_PATTERN)}) then 'cve' when regexp_matches(title || chr(10) || body, {_quoted(screening.LINKED_ISSUE)}) then 'linked-issue' else 'title-keyword' end as provenance from t""")
def screened_titles(spark, sf):
    """Why titles and bodies aren't those of a fix, or of an ordinary change, and where a fix's label comes from."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k, _pick(_TITLES, k, F.col("p_size")).alias("title"), _pick(_BODIES, F.expr("p_partkey div 24"), F.col("p_size")).alias("body"))
    t, b = F.col("title"), F.col("body")
    return rows.select("p_partkey", screening.screen_fix(t, b).alias("as_fix"), screening.screen_clean(t, b).alias("as_clean"), screening.label_provenance(t, b).alias("provenance"))


def _diff(path: str, body: str, extra: str = "") -> str:
    return f"diff --git a/{path} b/{path}\n{extra}--- a/{path}\n+++ b/{path}\n{body}"


_ONE = "@@ -5,3 +5,2 @@ def f(x):\n ctx\n-    if x == {}:\n-        go()\n+    if x >= {}:\n"
#: A diff, and what becomes of it as a fix and as an ordinary change ({} in the first diffs is the part's size).
_DIFFS = (
    (_diff("src/a.py", _ONE), None, None),
    (_diff("src/a.py", _ONE) + _diff("src/b.py", "@@ -1,2 +1 @@ class B:\n-await run({})\n ctx\n@@ -9 +8 @@\n-def g(): pass\n+def h(): pass\n"), None, None),
    (_diff("src/a.py", "@@ -1 +1,2 @@\n ctx\n+new {}\n"), "fix-adds-only", None),
    (_diff("tests/a.py", _ONE) + _diff("README.md", _ONE), "no-production-python", "no-production-python"),
    (_diff("src/a.py", _ONE, "new file mode 100644\n"), "unsupported-diff", "unsupported-diff"),
    (_diff("src/a.py", _ONE) + _diff("src/test_a.py", _ONE, "new file mode 100644\n"), None, None),
    (_diff("src/a.py", "@@ -1,21 +1 @@\n" + "-x\n" * 21), "too-many-lines", "too-many-lines"),
    ("".join(_diff(f"src/{c}.py", _ONE) for c in "abcd"), "too-many-files", "too-many-files"),
    (" \n\t", "empty-diff", "empty-diff"),
    ("--- a/x.py\n+++ b/x.py\n@@ -1 +1 @@\n-a\n+b\n", "unparsable-diff", "unparsable-diff"),
    (_diff("src/v.py", "@@ -1,2 +1,2 @@\n-__version__ = \"1.{}\"\n-release: str = 'x'\n+y\n"), "release-commit", None),
    (_diff("src/a.py", "@@ -1,11 +1 @@\n" + "".join(f"-x{i}\n" for i in range(11)) + "+y\n"), "seed-span-too-wide", None),
    (_diff("src/a.py", "@@ -1,3 +1 @@\n-# note {}\n-\n-  # more\n+y\n"), "fix-adds-only", None),
    (_diff("src/a.py", "@@ -3 +2,0 @@\n-h = hashlib.md5(k{})\n"), None, "no-added-lines"),
)
#: class, basis, difficulty and findings of the diffs that become cases.
_BUILT = {0: ("logic-boundary", "code-pattern", "L2", "src/a.py:6-7"), 1: ("concurrency", "code-pattern", "L4", "src/a.py:6-7,src/b.py:1-1,src/b.py:9-9"), 5: ("logic-boundary", "code-pattern", "L2", "src/a.py:6-7"), 13: ("crypto-weak", "code-pattern", "L1", "src/a.py:3-3")}


def _pulls(spark, sf, titles: tuple) -> DataFrame:
    k = F.col("p_partkey")
    return spread(table(spark, sf, "part").select("p_partkey", "p_brand", "p_size"), "p_partkey").select(
        k.cast("string").alias("key"), F.concat(F.lit("org/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).alias("repository"), k.cast("long").alias("number"), _pick(titles, F.expr("p_partkey div 14"), F.col("p_size")).alias("title"), F.lit("fixes #1" if titles is _FIXES else "").alias("body"),
        F.timestamp_add("DAY", (k % 400).cast("int"), F.lit("2024-01-01 12:00:00").cast("timestamp")).alias("merged_at"), _pick(tuple(d for d, _, _ in _DIFFS), k, F.col("p_size")).alias("diff"), F.when(k % 2 == 0, F.concat(F.lit("u"), k.cast("string"))).alias("html_url"),
    )


_FIXES, _PLAIN = ("Fix it {}", "Bump {}", "bug {}"), ("Add it {}", "Fix {}", "Speed {}")
_CUTOFF, _AS_OF = "2024-06-01 00:00:00", "2025-01-31 00:00:00"


def _sql_pulls(titles: tuple) -> str:
    return f"""p as (select p_partkey as k, 'org/' || lower(replace(p_brand, '#', '-')) as repository, {_sql_pick(titles, 'p_partkey // 14', 'p_size')} as title, timestamp '2024-01-01 12:00:00' + to_days((p_partkey % 400)::int) as merged_at, p_size from part)"""


def _sql_list(values) -> str:
    return "[" + ", ".join("null" if v is None else _quoted(v) for v in values) + "]"


@query(f"""with {_sql_pulls(_FIXES)}, r as (select *, case when starts_with(title, 'Bump') then 'excluded-keyword' else {_sql_list(d[1] for d in _DIFFS)}[k % 14 + 1] end as reason from p)
select k::varchar as key, reason, repository, k::bigint as pull_request, case when merged_at < timestamp '{_CUTOFF}' then 'pre-cutoff' else 'post-cutoff' end as contamination_split, case when k % 2 = 0 then 'u' || k else 'https://github.com/' || repository || '/pull/' || k end as fix_pr_url,
case when reason is null then replace(repository, '/', '__') || '-pr-' || k end as id, case when reason is null then {_sql_list(_BUILT.get(i, [None] * 4)[0] for i in range(14))}[k % 14 + 1] end as defect_class, case when reason is null then {_sql_list(_BUILT.get(i, [None] * 4)[1] for i in range(14))}[k % 14 + 1] end as basis,
case when reason is null then {_sql_list(_BUILT.get(i, [None] * 4)[2] for i in range(14))}[k % 14 + 1] end as difficulty, case when reason is null then {_sql_list(_BUILT.get(i, [None] * 4)[3] for i in range(14))}[k % 14 + 1] end as findings, case when reason is null then 'linked-issue' end as provenance from r""")
def fix_cases(spark, sf):
    """Cases built by reversing fixes, or why not; each part is a change whose diff is one of fourteen kinds."""
    out = cases.built_cases(_pulls(spark, sf, _FIXES), "validation", _CUTOFF)
    found = F.array_join(F.transform("expected_findings", lambda f: F.format_string("%s:%d-%d", f["path"], f["start_line"], f["end_line"])), ",")
    return out.select("key", "reason", "repository", "pull_request", "contamination_split", "fix_pr_url", "id", "defect_class", F.col("defect_class_basis").alias("basis"), "difficulty", found.alias("findings"), F.col("label_provenance").alias("provenance"))


@query(f"""with {_sql_pulls(_PLAIN)}, r as (select *, case when starts_with(title, 'Fix') then 'looks-like-a-bugfix' when floor(date_diff('second', merged_at, timestamp '{_AS_OF}') / 86400.0) < 180 then 'cooldown-not-elapsed' else {_sql_list(d[2] for d in _DIFFS)}[k % 14 + 1] end as reason from p)
select coalesce(reason, 'kept') as reason, count(*)::bigint as pulls, count(distinct repository)::bigint as repositories, min(k)::bigint as first from r group by all""")
def clean_case_funnel(spark, sf):
    """How many ordinary changes each check refuses, and how many become clean cases."""
    out = cases.built_clean_cases(_pulls(spark, sf, _PLAIN), "validation", _CUTOFF, _AS_OF)
    by = out.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason"), "repository").agg(F.count("*").alias("n"), F.min("pull_request").alias("first"))
    return by.groupBy("reason").agg(F.sum("n").alias("pulls"), F.count("*").alias("repositories"), F.min("first").alias("first"))


_QUOTA, _CLEAN_QUOTA, _PAGES, _TARGET, _CLEAN_TARGET = 12, 6, 4, 150, 60
_LISTED = """q as (select p_partkey as number, p_brand as repo, dense_rank() over (order by p_brand) - 1 as seq, row_number() over (partition by p_brand order by p_partkey) - 1 as i, p_size as s from part),
u as (select *, i // 10 + 1 as page, i % 10 as place, case when number % 4 = 0 then 'excluded-keyword' end as fs, case when number % 7 = 0 then 'too-many-lines' end as fr, 'd' || s || '-' || number % 3 as fp, case when number % 3 = 0 then 'looks-like-a-bugfix' end as cs, case when number % 11 = 0 then 'cooldown-not-elapsed' end as cr, 'd' || s || '-' || number % 2 as cp from q)"""


@query(f"""with recursive {_LISTED}, o as (select *, row_number() over (order by seq, page, place) as rn from u),
s as (select 0::bigint as rn, -1::bigint as seq, 0 as fixes, 0 as cleans, 0 as all_fixes, 0 as all_cleans, false as ended, []::varchar[] as seen, null::bigint as number, null::varchar as kind, '' as fate union all
select rn, seq, f0 + (fate = 'accepted' and kind = 'fix')::int, c0 + (fate = 'accepted' and kind = 'clean')::int, all_fixes + (fate = 'accepted' and kind = 'fix')::int, all_cleans + (fate = 'accepted' and kind = 'clean')::int, ended, case when fate = 'accepted' then list_append(seen, print) else seen end, number, case when fate <> 'not-reached' then kind end, fate from (
 select *, case when ended or page > {_PAGES} or (f0 >= {_QUOTA} and c0 >= {_CLEAN_QUOTA}) then 'not-reached' when early is not null then early when late is not null then late when list_contains(seen, print) then 'duplicate-diff' else 'accepted' end as fate from (
  select *, case when kind = 'fix' then fs else cs end as early, case when kind = 'fix' then fr else cr end as late, case when kind = 'fix' then fp else cp end as print from (
   select o.*, s.seen, s.all_fixes, s.all_cleans, case when o.seq = s.seq then s.fixes else 0 end as f0, case when o.seq = s.seq then s.cleans else 0 end as c0, s.ended or (o.seq <> s.seq and s.seq >= 0 and s.all_fixes >= {_TARGET} and s.all_cleans >= {_CLEAN_TARGET}) as ended,
    case when case when o.seq = s.seq then s.fixes else 0 end < {_QUOTA} then 'fix' else 'clean' end as kind from s join o on o.rn = s.rn + 1))))
select number, kind, fate from s where rn > 0""")
def collected_cases(spark, sf):
    """What becomes of every part, taken for a change of its brand's repository: quotas, duplicates across repositories, totals."""
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
    k = F.col("number")
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("repo"), F.col("p_partkey").alias("number"), F.col("p_size").alias("s"), place.alias("i"))
    pulls = rows.select(
        "repo", (F.floor(F.col("i") / 10) + 1).cast("int").alias("page"), (F.col("i") % 10).alias("place"), k, F.when(k % 4 == 0, "excluded-keyword").alias("fix_screen"), F.when(k % 7 == 0, "too-many-lines").alias("fix_reason"), F.format_string("d%d-%d", "s", k % 3).alias("fix_print"),
        F.when(k % 3 == 0, "looks-like-a-bugfix").alias("clean_screen"), F.when(k % 11 == 0, "cooldown-not-elapsed").alias("clean_reason"), F.format_string("d%d-%d", "s", k % 2).alias("clean_print"),
    )
    brands = rows.select("repo").distinct()
    plan = brands.select("repo", (F.row_number().over(Window.orderBy("repo")) - 1).alias("seq"), F.lit(_QUOTA).alias("quota"), F.lit(_CLEAN_QUOTA).alias("clean_quota"), F.lit(_PAGES).alias("max_pages"))  # a row a repository
    folder = shared_folder(spark)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    return collected(pulls, plan, written, None, _TARGET, _CLEAN_TARGET).where("number is not null").select("number", "kind", "fate")
