"""Archives of versions: what they hold, the frontier of what leads somewhere, and the parent of the next round by strategy and seed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRATEGIES = ("active", "best", "pareto", "epsilon_greedy")


def unit_interval(seed: Column) -> Column:
    """A number in [0, 1) by the first 64 bits of a text's SHA-256."""
    return F.conv(F.substring(F.sha2(seed.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(1 << 64))


def frontier(scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, version, leads: on how many cases (keys, version, case_id, score; null: not evaluated) a version has the best score, for those that lead anywhere."""
    known = scores.where("score is not null").groupBy(*keys, "version", "case_id").agg(F.max("score").alias("score"))
    best = known.groupBy(*keys, "case_id").agg(F.max("score").alias("best"))
    return known.join(best, [*keys, "case_id"]).where("score >= best").groupBy(*keys, "version").agg(F.count("*").alias("leads"))


def summary(versions: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """keys, versions, evaluated, frontier_size, active_version (the highest active), best_version, decisions (a map; null is `unknown`)."""
    scored = scores.where("score is not null").select(*keys, "version").distinct().withColumn("_scored", F.lit(True))
    led = frontier(scores, keys).groupBy(*keys).agg(F.count("*").alias("frontier_size"))
    known = F.coalesce("score", F.lit(float("-inf")))
    total = versions.join(scored, [*keys, "version"], "left").groupBy(*keys).agg(
        F.count("*").alias("versions"), F.count("_scored").alias("evaluated"), F.max(F.when(F.col("active"), F.col("version"))).alias("active_version"), F.max_by("version", F.struct(known, "version")).alias("best_version"),
    )
    by = versions.groupBy(*keys, F.coalesce("decision", F.lit("unknown")).alias("d")).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("d", "n")))).alias("decisions"))
    return total.join(led, keys, "left").na.fill(0, ["frontier_size"]).join(by, keys)


def parents(asked: DataFrame, versions: DataFrame, scores: DataFrame, keys: list[str]) -> DataFrame:
    """asked (keys, strategy, seed, epsilon) with version, resolved and fell_back_from: the version that the next round begins with; null for an archive without versions.

    active: the highest active one, else the best. best: by score, then by number. pareto: drawn from the frontier in proportion to the cases led, else as active. epsilon_greedy: any version with probability epsilon,
    else the best. Draws are hashes of the seed. An unknown strategy is an error.
    """
    all_ = Window.partitionBy(*keys)
    led = frontier(scores, keys).select(*keys, "version", "leads", F.sum("leads").over(all_.orderBy("version").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("leads").over(all_).alias("all"))
    led = led.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("version", "upto"))).alias("led"), F.max("all").alias("all"))
    held = versions.groupBy(*keys).agg(
        F.max(F.when(F.col("active"), F.col("version"))).alias("_active"), F.max_by("version", F.struct(F.coalesce("score", F.lit(float("-inf"))), "version")).alias("_best"), F.sort_array(F.collect_list("version")).alias("_versions"),
    )
    rows = asked.join(held, keys, "left").join(led, keys, "left")
    u = unit_interval(F.coalesce("seed", F.lit("")))
    drawn = F.coalesce(F.get(F.filter("led", lambda x: u * F.col("all") < x["upto"]), F.lit(0))["version"], F.element_at("led", -1)["version"])
    n = F.size("_versions")
    explored = F.get("_versions", (F.floor(unit_interval(F.concat(F.coalesce("seed", F.lit("")), F.lit(":explore"))) * n) % n).cast("int"))
    fallback = F.struct(F.coalesce("_active", "_best").alias("version"), F.when(F.col("_active").isNotNull(), "active").otherwise("best").alias("resolved"))
    one = lambda version, how, was="": F.struct(version.alias("version"), F.lit(how).alias("resolved"), F.lit(was).alias("fell_back_from"))
    fell = lambda was: F.struct(fallback["version"].alias("version"), fallback["resolved"].alias("resolved"), was.alias("fell_back_from"))
    s = F.col("strategy")
    explores = u < F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("epsilon", F.lit(0.1))))
    kind = "struct<version: bigint, resolved: string, fell_back_from: string>"
    unknown = F.raise_error(F.concat(F.lit("no such strategy: "), F.coalesce(s, F.lit("null")))).cast(kind)
    choice = (
        F.when(~F.coalesce(s.isin(*STRATEGIES), F.lit(False)), unknown).when(F.col("_best").isNull(), F.lit(None).cast(kind)).when(s == "active", fell(F.when(F.col("_active").isNotNull(), "").otherwise("active")).cast(kind))
        .when(s == "best", one(F.col("_best"), "best").cast(kind)).when((s == "pareto") & F.col("led").isNull(), fell(F.lit("pareto")).cast(kind)).when(s == "pareto", one(drawn, "pareto").cast(kind))
        .when(explores, one(explored, "explore").cast(kind)).otherwise(one(F.col("_best"), "exploit").cast(kind))
    )
    return rows.select(*asked.columns, choice.alias("_c")).select(*asked.columns, "_c.*")
