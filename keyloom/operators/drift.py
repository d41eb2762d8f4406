"""Comparing and merging inventories: diffs, matching, baselines, de-duplication of passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def last_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison by null-safe keys: added, removed, changed or unchanged, with the changed columns' names."""
    b = before.select(*(F.col(k).alias(f"b_{k}") for k in keys), *(F.col(v).alias(f"b_{v}") for v in values), F.lit(1).alias("_b"))
    a = after.select(*keys, *values, F.lit(1).alias("_a"))
    on = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    j = a.join(b, on, "full_outer")
    names = F.filter(F.array(*(F.when(~F.col(v).eqNullSafe(F.col(f"b_{v}")), v) for v in values)), lambda x: x.isNotNull())
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.size(names) > 0, "changed").otherwise("unchanged")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return j.select(*(F.coalesce(k, f"b_{k}").alias(k) for k in keys), change.alias("change"), F.when(both, F.array_join(names, ",")).otherwise("").alias("changes"))


def merge(df: DataFrame, keys: list[str], order: str, *ties: str) -> DataFrame:
    """Union of inventories: of each key the row of the greatest ``order`` stays."""
    return last_by(df, keys, [F.desc(order), *(F.desc(t) for t in ties)])


def match_findings(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Action and next status by (project_id, fingerprint); a null fingerprint never matches."""
    e = existing.where("fingerprint IS NOT NULL").select("project_id", "fingerprint", "status", "reopen_count", F.lit(1).alias("_e"))
    n = new.where("fingerprint IS NOT NULL").select("project_id", "fingerprint").distinct().withColumn("_n", F.lit(1))
    j = e.join(n, ["project_id", "fingerprint"], "full_outer")
    s = F.col("status")
    action = (F.when(F.col("_e").isNull(), "new").when(F.col("_n").isNotNull() & (s == "resolved"), "reopened").when(F.col("_n").isNotNull(), "matched")
              .when(s.isin("open", "in_review", "in_progress"), "resolved").otherwise("kept"))
    out = j.withColumn("action", action)
    status = F.when(F.col("action").isin("new", "reopened"), "open").when(F.col("action") == "resolved", "resolved").otherwise(s)
    count = F.coalesce("reopen_count", F.lit(0)) + (F.col("action") == "reopened").cast("int")
    keyless = new.where("fingerprint IS NULL").select("project_id", "fingerprint", F.lit("new").alias("action"), F.lit("open").alias("next_status"), F.lit(0).alias("reopen_count"))
    return out.select("project_id", "fingerprint", "action", status.alias("next_status"), count.alias("reopen_count")).unionByName(keyless)


def eligible(category):
    """What a baseline may suppress: everything but inventory; an empty category counts as security."""
    return F.coalesce(category, F.lit("security")) != "inventory"


def apply_baseline(findings: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(rows kept, stale baseline entries)."""
    entries = baseline.select(key).distinct()
    ok = eligible(F.col("category"))
    kept = findings.where(ok).join(entries, key, "left_anti").unionByName(findings.where(~ok))
    return kept, entries.join(findings.where(ok).select(key), key, "left_anti")


RANK = {"high": 3, "medium": 2, "low": 1}


def dedupe_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Pass-1 rows that absorb pass 2 by (lower file, line, lower name), then the pass-2 rows without a partner.

    Only the last pass-1 row of a key absorbs; the more confident side gives confidence and severity."""
    key = [F.lower("file").alias("k_file"), F.col("line").alias("k_line"), F.lower("name").alias("k_name")]
    names = ["k_file", "k_line", "k_name"]
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    p1 = first.select("*", *key).withColumn("last", F.row_number().over(W.partitionBy(*names).orderBy(F.desc("finding_id"))) == 1).withColumn("r1", rank)
    p2 = second.select(*key, "confidence", "severity", "description", "finding_id").withColumn("r2", rank)
    best = p2.groupBy(*names).agg(F.max_by(F.struct("confidence", "severity", "r2"), F.struct("r2", "finding_id")).alias("b"), F.array_join(F.array_sort(F.collect_set("description")), "; ").alias("extra"))
    j = p1.join(best, names, "left")
    takes = F.col("last") & F.col("b").isNotNull()
    better = takes & (F.col("b.r2") > F.col("r1"))
    merged = j.select("finding_id", "file", "line", "name", F.when(better, F.col("b.confidence")).otherwise(F.col("confidence")).alias("confidence"), F.when(better, F.col("b.severity")).otherwise(F.col("severity")).alias("severity"),
                      F.when(takes & ~F.col("description").contains(F.col("extra")), F.concat("description", F.lit(" [Pass 2: "), "extra", F.lit("]"))).otherwise(F.col("description")).alias("description"))
    alone = second.select("*", *key).join(p1.select(*names).distinct(), names, "left_anti")
    return merged.unionByName(alone.select("finding_id", "file", "line", "name", "confidence", "severity", "description"))


def versions(scans: DataFrame) -> DataFrame:
    """Version number of each scan of a project by time."""
    return scans.withColumn("version", F.row_number().over(W.partitionBy("project_id").orderBy("completed_at", "scan_id")))


def colocation(findings: DataFrame) -> DataFrame:
    """Links between consecutive findings of a file."""
    w = W.partitionBy("project_id", "file").orderBy("line", "finding_id")
    return findings.select("project_id", "file", F.col("finding_id").alias("source"), F.lead("finding_id").over(w).alias("target")).where("target IS NOT NULL")


def property_map(rows: DataFrame, columns: list[str]) -> Column:
    """All leaves of columns by their path (``crypto.mode``) as text: structs and maps are gone down into, an array counts as the sorted set of its values."""

    def leaves(value: Column, kind: T.DataType, path: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in leaves(value[f.name], f.dataType, f"{path}.{f.name}")]
        if isinstance(kind, T.MapType):
            named = F.transform_keys(value.cast("map<string,string>"), lambda k, v: F.concat(F.lit(f"{path}."), k))
            return [F.coalesce(named, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))]
        if isinstance(kind, T.ArrayType):
            inner = value.cast("array<string>") if not isinstance(kind.elementType, (T.StructType, T.MapType, T.ArrayType)) else F.transform(value, lambda v: F.to_json(v))
            return [F.create_map(F.lit(path), F.array_join(F.array_sort(F.array_distinct(inner)), ","))]
        return [F.create_map(F.lit(path), value.cast("string"))]

    return F.map_concat(*(x for c in columns for x in leaves(F.col(c), rows.schema[c].dataType, c)))


def diff_properties(before: DataFrame, after: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """Two inventories by null-safe keys: added, removed, changed or unchanged, with every property that differs as (property, before, after) in
    the order of names. Of several rows of a key the last by ``order`` counts; a property that one side lacks is null there."""

    def last(rows: DataFrame, name: str) -> DataFrame:
        named = [F.col(k).alias(f"{name}_{k}") for k in keys]
        kept = rows.groupBy(*named).agg(F.max_by(F.struct(*columns), order).alias("_kept")).select("*", "_kept.*")
        return kept.select(*(f"{name}_{k}" for k in keys), F.when(F.col("_kept").isNotNull(), property_map(kept, columns)).alias(name))

    b, a = last(before, "b"), last(after, "a")
    j = a.join(b, [F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in keys], "full_outer")
    both = F.map_zip_with("b", "a", lambda k, x, y: F.when(~x.eqNullSafe(y), F.struct(k.alias("property"), x.alias("before"), y.alias("after"))))
    found = F.array_sort(F.filter(F.map_values(both), lambda x: x.isNotNull()))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.size(found) > 0, "changed").otherwise("unchanged")
    shown = [F.when(F.col("a").isNull(), F.col(f"b_{k}")).otherwise(F.col(f"a_{k}")).alias(k) for k in keys]
    return j.select(*shown, change.alias("change"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), found).otherwise(F.array().cast("array<struct<property:string,before:string,after:string>>")).alias("changes"))
