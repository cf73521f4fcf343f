"""Queries that run as streams over a table's files and return what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from revlytics.plans.registry import query, shared_folder, table
from revlytics.sources.lines import not_json, numbered_lines
from revlytics.streaming.stateful import Rollout, rollouts, state_store

#: Samples at least, rates of failures and disagreements at most.
LEAST, ERRORS, DISAGREEMENT = 20, 0.21, 0.75


@query(f"""with recursive e as (select user_id % 64 as key, event_id, case when event_id % 97 = 0 then 'stage' when event_type = 'purchase' then 'shadow' else 'result' end as kind, event_id % 5 as candidate, event_type = 'error' as failed, value > 50 as differs,
row_number() over (partition by user_id % 64 order by event_id) as rn from events),
s as (select key, 0::bigint as rn, null::bigint as event_id, null::varchar as status, null::bigint as candidate, null::bigint as stable, 0::bigint as n, 0::bigint as errors, 0::bigint as shadow, 0::bigint as differ, '' as what from (select distinct key from e) union all
select key, rn, event_id, case when what in ('staged', 'already running', 'refused') then 'running' when what in ('rolled_back', 'promoted') then what else status end as status, case when what = 'staged' then own else candidate end as candidate, case when what = 'promoted' then candidate else stable end as stable,
 case when what = 'staged' then 0 else n end as n, case when what = 'staged' then 0 else errors end as errors, case when what = 'staged' then 0 else shadow end as shadow, case when what = 'staged' then 0 else differ end as differ, what from (
 select *, case when kind = 'stage' then case when status = 'running' then case when candidate = own then 'already running' else 'refused' end else 'staged' end when status is null then 'ignored'
  when kind = 'result' and status = 'running' and n >= {LEAST} and errors / n > {ERRORS} then 'rolled_back'
  when kind = 'shadow' and status = 'running' and shadow >= {LEAST} and differ / shadow <= {DISAGREEMENT} and (n = 0 or errors / n <= {ERRORS}) and not failed then 'promoted' else 'counted' end as what from (
  select s.key, e.rn, e.event_id, e.kind, e.candidate as own, e.failed, s.status, s.candidate, s.stable, s.n + (s.status is not null and kind = 'result')::int as n, s.errors + (s.status is not null and kind = 'result' and failed)::int as errors,
   s.shadow + (s.status is not null and kind = 'shadow')::int as shadow, s.differ + (s.status is not null and kind = 'shadow' and differs)::int as differ from s join e on e.key = s.key and e.rn = s.rn + 1)))
select key, max(rn)::bigint as events, count_if(what = 'staged')::bigint as staged, count_if(what = 'refused')::bigint as refused, count_if(what = 'rolled_back')::bigint as rolled_back, count_if(what = 'promoted')::bigint as promoted, arg_max(status, rn) as status,
arg_max(candidate, rn) filter (where status is not null) as candidate, arg_max(stable, rn) filter (where stable is not null) as stable, arg_max(n, rn)::bigint as samples, arg_max(errors, rn)::bigint as errors, arg_max(shadow, rn)::bigint as shadow_samples, arg_max(differ, rn)::bigint as disagreements
from s where rn > 0 group by key""")
def rollout_stream(spark, sf):
    """Rollouts of 64 keys, as a stream with state over the events' files: what happened, and the state at the end."""
    kind = F.when(F.col("event_id") % 97 == 0, "stage").when(F.col("event_type") == "purchase", "shadow").otherwise("result")
    log = table(spark, sf, "events").schema
    stream = spark.readStream.schema(log).parquet(f"{sf}/events.parquet*")  # a pattern, so that the table may be a file or a folder
    events = stream.select((F.col("user_id") % 64).alias("key"), "event_id", kind.alias("kind"), (F.col("event_id") % 5).alias("candidate"), (F.col("event_type") == "error").alias("failed"), (F.col("value") > 50).cast("double").alias("disagreement"))
    folder = shared_folder(spark)
    with state_store(spark):
        run = rollouts(events, Rollout(LEAST, ERRORS, DISAGREEMENT, True), every=True)
        run.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    rows = spark.read.schema(run.schema).parquet(f"{folder}/rows")
    counts = [F.count_if(F.col("what") == w).alias(w) for w in ("staged", "refused", "rolled_back", "promoted")]
    state = F.max_by(F.struct("status", "candidate", "stable", "samples", "errors", "shadow_samples", "disagreements"), "event_id")
    none = F.lit(0).cast("long")
    out = rows.groupBy("key").agg(F.count("*").alias("events"), *counts, state.alias("s"))
    zero = [F.coalesce(F.col("s")[c], none).alias(c) for c in ("samples", "errors", "shadow_samples", "disagreements")]
    return out.select("key", "events", "staged", "refused", "rolled_back", "promoted", "s.status", "s.candidate", "s.stable", *zero)


@query("""with d as (select doc_id % 4 as bucket, row_number() over (partition by doc_id % 4 order by doc_id) as line, case when doc_id % 7 = 0 then '  ' when doc_id % 13 = 0 then '{"doc_id":' || doc_id || ',}' else '{}' end as value from documents where doc_id is not null)
select bucket, line, value from d where value not in ('  ', '{}')""")
def bad_lines(spark, sf):
    """Lines that aren't JSON, with their numbers, of four files of JSON lines that the documents are written to."""
    k = F.col("doc_id")
    rows = table(spark, sf, "documents").where("doc_id is not null").select((k % 4).alias("bucket"), "doc_id", F.when(k % 7 == 0, "  ").when(k % 13 == 0, F.format_string('{"doc_id":%d,}', k)).otherwise(F.to_json(F.struct("doc_id", "text"))).alias("value"))
    folder = shared_folder(spark)
    # Ranges of ids, not whole buckets, are dealt to tasks: each file is written in parts, whose names are in the order of the ranges.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows.repartitionByRange(parts, "bucket", "doc_id").sortWithinPartitions("bucket", "doc_id").drop("doc_id").write.partitionBy("bucket").text(folder)
    found = numbered_lines(spark, folder, not_json, in_parts=True)
    return found.select(F.regexp_extract("file", r"bucket=(\d+)/", 1).cast("long").alias("bucket"), "line", "value")
