"""Symbols of the Python sources that suppliers make: each imports the next two."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlytics.operators import symbols
from revlytics.plans.registry import query, table

_SOURCE = """import m%2$d as n
from m%3$d import f%3$d as g

def f%1$d():
    n.f%2$d()
    g()
    f%1$d()
    unknown()

class C%1$d:
    def a(self):
        self.b()
    def b(self):
        f%1$d()
"""


def _facts(spark, sf) -> DataFrame:
    k = F.col("s_suppkey")
    files = table(spark, sf, "supplier").select(F.lit("r").alias("repo"), F.format_string("m%d.py", k).alias("path"), F.when(k % 10 == 7, "def (").otherwise(F.format_string(_SOURCE, k, k + 1, k + 2)).alias("content"))
    return symbols.facts(files, ["repo"])


_RIGHT = "select s_suppkey as k from supplier where s_suppkey % 10 <> 7"


@query(f"""with s as ({_RIGHT}), c as (select 'm' || k || '.py' as path, unnest([5, 6, 7, 8, 12, 14]) as line, unnest(['f' || k, 'f' || k, 'f' || k, 'f' || k, 'C' || k || '.a', 'C' || k || '.b']) as scope, unnest(['n', '', '', '', 'self', '']) as owner, unnest(['f' || k + 1, 'g', 'f' || k, 'unknown', 'b', 'f' || k]) as name,
unnest([k + 1, k + 2, k, null, k, k]) as t, unnest(['', '', '', null, 'C' || k, '']) as ts, unnest(['module', 'import', 'local', null, 'method', 'local']) as h from s)
select path, line, scope, owner, name, case when s.k is not null then 'm' || t || '.py' end as to_path, case when s.k is not null then ts end as to_scope, case when s.k is not null then h end as how from c left join s on s.k = c.t""")
def symbol_calls(spark, sf):
    """Every call of every source, with the definition that it means where that can be told."""
    return symbols.resolved_calls(_facts(spark, sf), ["repo"]).drop("repo")


@query(f"""with s as ({_RIGHT}) select 'f' || s.k as name, 'm' || s.k || '.py:4' as definitions, array_to_string(list_filter(['m' || s.k || '.py:7', 'm' || s.k || '.py:14', case when p.k is not null then 'm' || p.k || '.py:5' end], lambda x: x is not null).list_sort(), ',') as callers, array_to_string(list_sort(['f' || s.k, 'f' || s.k + 1, 'g', 'unknown']), ',') as callees
from s left join s p on p.k = s.k - 1""")
def symbol_uses(spark, sf):
    """Where each function is defined and called, and what it calls."""
    out = symbols.symbol(_facts(spark, sf), ["repo"]).where("name like 'f%'")
    places = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.concat_ws(":", x["path"], x["line"].cast("string")))), ",")
    return out.select("name", places("definitions").alias("definitions"), places("callers").alias("callers"), F.array_join(F.array_sort("callees.symbol"), ",").alias("callees"))
