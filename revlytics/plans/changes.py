"""Patches applied, lines changed, and what fits a budget: queries over files and hunks that the tables' texts make."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlytics.operators import alignment, folds, patches
from revlytics.operators.diffs import lines_of
from revlytics.plans.registry import query, table


def _files(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").where("text <> '' and doc_id is not null")
    return docs.select(F.col("doc_id").alias("case_id"), F.lit("src/a.py").alias("path"), F.col("text").alias("content"))


def _patches(files: DataFrame) -> DataFrame:
    """Every seventh line goes, after every fifth comes a new one; by one hunk or by a hunk a line. Cases 0 to 5 of ten have something wrong."""
    own = lines_of(F.col("content"))
    rows = files.select("case_id", own.alias("own"), (F.col("case_id") % 10).alias("odd"))
    gone, more = lambda i: (i + 1) % 7 == 0, lambda i: (i + 1) % 5 == 0
    new = lambda i: F.concat(F.lit("\n+new "), (i + 1).cast("string"))
    n = F.size("own")
    body = F.transform("own", lambda x, i: F.concat(F.when(gone(i), "-").otherwise(" "), F.when((F.col("odd") == 0) & (i == 0), F.concat(F.lit("stale "), x)).otherwise(x), F.when(more(i), new(i)).otherwise("")))
    n_new = n - F.floor(n / 7) + F.floor(n / 5) + F.when(F.col("odd") == 1, 1).otherwise(0)
    one = F.concat(F.format_string("@@ -1,%d +1,%d @@\n", n, n_new.cast("int")), F.array_join(body, "\n"))
    hunk = lambda x, i: (
        F.when(gone(i), F.concat(F.format_string("@@ -%1$d,1 +%1$d,%2$d @@\n-", i + 1, F.when(more(i), 1).otherwise(0)), x, F.when(more(i), new(i)).otherwise("")))
        .when(more(i), F.concat(F.format_string("@@ -%d,0 +%d,1 @@", i + 2, i + 1), new(i)))
    )
    each = F.array_join(F.concat(F.array(F.lit("@@ -1,0 +1,0 @@")), F.array_compact(F.transform("own", hunk))), "\n")
    name = F.when(F.col("odd") == 2, "src/b.py").otherwise("src/a.py")
    head = F.concat(F.when(F.col("odd") == 3, "x\n").otherwise(""), F.format_string("--- a/%1$s\n+++ b/%1$s\n", name))
    tail = F.when(F.col("odd") == 4, F.concat(F.lit("\n@@ -1 +1 @@\n "), F.get("own", 0))).when(F.col("odd") == 5, "\n\n+y").otherwise("")
    return rows.select("case_id", F.concat(head, F.when((F.col("odd") % 2 == 1) | (F.col("odd") < 6), one).otherwise(each), tail, F.lit("\n")).alias("patch"))


@query("""with f as (select doc_id as case_id, doc_id % 10 as odd, text, string_split(text, chr(10)) as s from documents where text <> '' and doc_id is not null),
o as (select case_id, odd, text, case when s[-1] = '' then s[:-2] else s end as own from f),
n as (select *, array_to_string(flatten(list_transform(own, lambda x, i: (case when i % 7 = 0 then [] else [x] end) || (case when i % 5 = 0 then ['new ' || i] else [] end))), chr(10)) || case when ends_with(text, chr(10)) then chr(10) else '' end as content from o)
select case_id, case when odd > 5 then 'src/a.py' end as path, case when odd > 5 then sha256(content) end as content_sha256,
case odd when 0 then 'context differs' when 1 then 'line counts differ' when 2 then 'path not allowed' when 3 then 'content outside a file header' when 4 then 'overlapping or out of range' when 5 then 'invalid patch line' end as reason,
case odd when 0 then 4 when 1 then 3 + len(own) + len(own) // 5 when 2 then 2 when 3 then 1 when 4 then 4 + len(own) + len(own) // 5 when 5 then 4 + len(own) + len(own) // 5 end::bigint as line from n""")
def applied_patches(spark, sf):
    """Patches of all documents applied to their texts, or why not and at which line of the patch."""
    files = _files(spark, sf)
    out = patches.apply_patches(_patches(files), files)
    return out.select("case_id", "path", F.sha2(F.col("content").cast("binary"), 256).alias("content_sha256"), "reason", "line")


@query("""with f as (select doc_id, string_split(text, chr(10)) as s from documents where text <> '' and doc_id is not null), o as (select doc_id, case when s[-1] = '' then s[:-2] else s end as own from f),
l as (select doc_id, len(own) as n, 1 + doc_id % 40 as line, list_filter(range(1, len(own) + 1), lambda i: i % 9 = 0 or i % 11 = 0) as mid, doc_id % 3 = 0 as imported from o),
a as (select *, list_distinct((case when imported then [1] else [] end) || mid || (case when doc_id % 4 = 0 and n % 9 > 0 and n % 11 > 0 then [n + 1] else [] end)) as changed, mid || (case when doc_id % 4 = 0 and n % 9 > 0 and n % 11 > 0 then [n + 1] else [] end) as strict from l)
select doc_id, array_to_string(list_sort(changed), ',') as changed_lines, array_to_string(list_sort(list_filter(strict, lambda x: x < line - 5 or x > line + 5)), ',') as out_of_scope, imported::bigint as import_insertions,
len(list_filter(strict, lambda x: x < line - 5 or x > line + 5)) = 0 as passed from a""")
def changed_line_scope(spark, sf):
    """Lines that a rewritten text changes, and those too far from the finding. Lines before carry their number, so the script is the only shortest."""
    rows = _files(spark, sf).select(F.col("case_id").alias("doc_id"), lines_of(F.col("content")).alias("own"), (F.col("case_id") % 40 + 1).cast("int").alias("line"))
    numbered = F.transform("own", lambda x, i: F.concat((i + 1).cast("string"), F.lit(" "), x))
    edited = F.filter(F.transform(numbered, lambda x, i: F.when((i + 1) % 11 == 0, F.concat(F.lit("edited "), x)).when((i + 1) % 9 != 0, x)), lambda x: x.isNotNull())
    id_ = F.col("doc_id")
    after = F.concat(F.when(id_ % 3 == 0, F.array(F.lit("import os"), F.lit(" from a import b"))).otherwise(F.array().cast("array<string>")), edited, F.when(id_ % 4 == 0, F.array(F.lit("at the end"))).otherwise(F.array().cast("array<string>")))
    text = lambda x: F.concat(F.array_join(x, "\n"), F.lit("\n"))
    out = alignment.patch_scope(rows, text(numbered), F.when(F.size(after) > 0, text(after)).otherwise(""), "line", ["doc_id"])
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("changed_lines", "out_of_scope")})


HUNK_BUDGET, RECORD_BUDGET = 6000, 400


@query(f"""with recursive h as (select l_suppkey as case_id, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 as hunk, l_partkey % 20 as p, l_quantity as q, l_partkey from lineitem),
x as (select case_id, hunk, p, 25 as head, 13 + len(hunk::varchar) as h, 1 + 6 * (hunk % 11 + 1) as a1, 1 + 5 * (l_partkey % 60 + 1) as a2, row_number() over (partition by case_id order by q desc, hunk) as rn from h),
s as (select case_id, 0::bigint as rn, -1::bigint as hunk, 0::bigint as used, []::bigint[] as paid, false as over, '' as decision, 0::bigint as bytes from (select distinct case_id from x) union all
 select case_id, rn, hunk, used + case when decision = 'dropped' then 0 else fee + bytes end, case when decision = 'dropped' then paid else list_append(paid, p) end, over or (short and used + case when decision = 'dropped' then 0 else fee + bytes end >= {HUNK_BUDGET}), decision, bytes from (
  select *, case when over then 'dropped' when not short then 'kept' when bytes > 0 then 'compacted' else 'dropped' end as decision from (
   select *, case when over then 0 when not short then h + a1 + a2 when room < 128 then 0 else h + case when h + a1 <= lim then a1 + case when h + a1 + a2 <= lim then a2 else 0 end else 0 end end as bytes from (
    select *, greatest(128, floor(room * 0.85::double)) as lim from (
     select *, {HUNK_BUDGET} - used - fee as room, not over and used + fee + h + a1 + a2 > {HUNK_BUDGET} as short from (
      select s.case_id, s.rn + 1 as rn, x.hunk, s.used, s.paid, s.over, x.p::bigint as p, x.h, x.a1, x.a2, case when list_contains(s.paid, x.p) then 0 else x.head end as fee from s join x on x.case_id = s.case_id and x.rn = s.rn + 1))))))
select case_id, hunk, decision, bytes::bigint as bytes from s where rn > 0""")
def hunks_in_budget(spark, sf):
    """Hunks of every supplier's review within a budget of bytes, the largest quantity first; what doesn't fit is shortened or left out."""
    return folds.chosen_hunks(_hunks(spark, sf), HUNK_BUDGET).select("case_id", "hunk", "decision", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))


def _hunks(spark, sf) -> DataFrame:
    place = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("case_id"), (F.row_number().over(place) - 1).cast("long").alias("hunk"), "l_partkey", F.col("l_quantity").alias("score"))
    path = F.format_string("%03d", F.col("l_partkey") % 20)
    text = F.concat(F.format_string("@@ -%1$d +1,2 @@\n", "hunk"), F.repeat(F.lit("+line "), (F.col("hunk") % 11 + 1).cast("int")), F.lit("\n"), F.repeat(F.lit("+more"), (F.col("l_partkey") % 60 + 1).cast("int")), F.lit("\n"))
    return rows.select("case_id", "hunk", path.alias("path"), F.format_string("--- a/%1$s\n+++ b/%1$s\n----\n", path).alias("header"), text.alias("text"), "score")


@query(f"""with recursive o as (select o_custkey as case_id, row_number() over (partition by o_custkey order by o_orderkey) as place, 20 + o_orderkey % 83 as size, o_orderkey % 3 > 0 as optional from orders),
s as (select case_id, 0::bigint as place, 0::bigint as used, '' as decision, 0::bigint as bytes from (select distinct case_id from o) union all
 select case_id, place, used + bytes, decision, bytes from (select *, case decision when 'kept' then size when 'clipped' then room + 1 else 0 end as bytes from (
  select s.case_id, o.place, s.used, o.size, {RECORD_BUDGET} - s.used as room, case when o.size <= {RECORD_BUDGET} - s.used then 'kept' when o.optional or {RECORD_BUDGET} - s.used < 48 then 'dropped' else 'clipped' end as decision from s join o on o.case_id = s.case_id and o.place = s.place + 1)))
select case_id, place, decision, bytes::bigint as bytes from s where place > 0""")
def records_in_budget(spark, sf):
    """Every customer's orders as records of a bounded context: kept, clipped or dropped."""
    orders = table(spark, sf, "orders")
    text = F.rpad(F.concat(F.lit("ORDER: "), F.col("o_orderkey").cast("string")), F.lit(20) + (F.col("o_orderkey") % 83).cast("int"), F.lit("."))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    rows = orders.select(F.col("o_custkey").alias("case_id"), place.cast("long").alias("place"), text.alias("text"), (F.col("o_orderkey") % 3 > 0).alias("optional"))
    return folds.packed_records(rows, RECORD_BUDGET).select("case_id", "place", "decision", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
