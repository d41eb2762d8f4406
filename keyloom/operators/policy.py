"""Policies, cascades, roles, status rules and filters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions import crypto as X
from keyloom.operators.portfolio import with_posture

RULES = "rule string, severity string, action string, deny_algorithms array<string>, deny_posture array<string>, min_key_size int, algorithm string, min_severity string, deny_modes array<string>, deny_tls_versions array<string>"
#: More rules than this are refused: they become one expression of the plan.
MAX_RULES = 1000
DEFAULT_RULES = (
    ("no-broken", "critical", "fail", None, ["broken"], None, None, None),
    ("no-legacy-hash", "high", "fail", ["md5", "sha1"], None, None, None, None),
    ("rsa-size", "medium", "warn", None, None, 3072, "rsa", None),
    ("urgent", "high", "warn", None, None, None, None, "critical"),
    ("no-md4", "low", "fail", ["md4"], None, None, None, None),
)


def rules(spark: SparkSession, rows=DEFAULT_RULES) -> DataFrame:
    width = len(RULES.split(", "))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], RULES)


def _holds(rule, columns: list[str]):
    """Whether any condition of a rule holds; the finding's mode and protocol version count where it has them."""
    low = lambda values: [v.lower() for v in values]
    checks = [F.lit(False)]
    if rule.deny_algorithms:
        checks.append(F.lower("family").isin(low(rule.deny_algorithms)))
    if rule.deny_posture:
        checks.append(F.lower("posture").isin(low(rule.deny_posture)))
    if rule.min_key_size and rule.algorithm:
        checks.append((F.lower("family") == rule.algorithm.lower()) & (F.col("key_size") > 0) & (F.col("key_size") < rule.min_key_size))
    if rule.min_severity:
        checks.append(X.severity_rank(F.col("severity")) >= X.SEVERITY_RANK.get(rule.min_severity.lower(), 99))
    if rule.deny_modes and "mode" in columns:
        checks.append(F.lower("mode").isin(low(rule.deny_modes)))
    if rule.deny_tls_versions and "protocol_version" in columns:
        checks.append(F.col("protocol_version").isin(list(rule.deny_tls_versions)))
    return F.greatest(*(F.coalesce(c, F.lit(False)) for c in checks), F.lit(False))


def violations(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """(finding, rule) for every rule with a condition that holds. The rules, ``MAX_RULES`` at most, become one array of
    conditions, so findings are read once and nothing is joined."""
    stated = rules.limit(MAX_RULES + 1).collect()
    if len(stated) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    rows = with_posture(findings)
    hit = lambda r: F.when(_holds(r, rows.columns), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("rule_severity"), F.lit(r.action).alias("action")))
    hits = F.array_compact(F.array(*map(hit, stated))) if stated else F.array().cast("array<struct<rule:string,rule_severity:string,action:string>>")
    return rows.select("*", F.inline(hits))


def evaluate(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations and violating projects of each rule; a rule without one passes."""
    by = violations(findings, rules).groupBy("rule").agg(F.count("*").alias("violations"), F.countDistinct("project_id").alias("projects"))
    return rules.select("rule", "action").join(by, "rule", "left").select("rule", "action", F.coalesce("violations", F.lit(0).cast("long")).alias("violations"), F.coalesce("projects", F.lit(0).cast("long")).alias("projects"), F.col("violations").isNull().alias("passed"))


def gate(findings: DataFrame, rules: DataFrame, fail_on: str = "high") -> DataFrame:
    """Failures and warnings of each project by the rules' severity."""
    bad = X.severity_rank(F.col("rule_severity")) >= X.SEVERITY_RANK[fail_on]
    return violations(findings, rules).groupBy("project_id").agg(F.count_if(bad).alias("failures"), F.count_if(~bad).alias("warnings"), F.countDistinct("rule").alias("rules"))


def cascade(base: DataFrame, levels: list[DataFrame], key: str) -> DataFrame:
    """Effective action of each key: a deeper level wins unless one above is locked. A level has (key, action, locked)."""
    out = base.select(key, F.lit("default").alias("source"), F.lit("fail").alias("action"), F.lit(False).alias("locked"))
    for name, level in levels:
        own = level.select(key, F.col("action").alias("a"), F.col("locked").alias("l"))
        takes = F.col("a").isNotNull() & ~F.col("locked")
        out = out.join(own, key, "left").select(key, F.when(takes, name).otherwise(F.col("source")).alias("source"), F.when(takes, F.col("a")).otherwise(F.col("action")).alias("action"), (F.col("locked") | F.coalesce("l", F.lit(False))).alias("locked"))
    return out


def drop_reason(category, enabled, maturity, allowed=(), disabled=(), mode: str = "security"):
    """Why a row goes: default gate, category, disabled; null if it stays."""
    on = F.coalesce(enabled, F.lit(True)) | F.coalesce(F.col("rule_id").isin(*allowed) if allowed else F.lit(False), F.lit(False))
    off = F.col("rule_id").isin(*disabled) if disabled else F.lit(False)
    return F.when(~on, "default-off").when(F.lit(mode == "security") & (F.coalesce(category, F.lit("security")) == "inventory"), "category").when(off, "disabled").when(maturity == "deprecated", None)


#: The asset types that a filter may name.
ASSET_TYPES = ("algorithm", "protocol", "certificate", "related-crypto-material", "library")


def filter_asset_types(findings: DataFrame, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Findings of the types included (all if none is named) less those excluded; a type that doesn't exist is an error."""
    named = lambda values: [v.strip().lower() for v in values if v.strip()]
    if wrong := [v for v in named(include) + named(exclude) if v not in ASSET_TYPES]:
        raise ValueError(f"no asset types: {', '.join(wrong)} (valid: {', '.join(sorted(ASSET_TYPES))})")
    rows = findings.where(F.col("asset_type").isin(named(include))) if named(include) else findings
    return rows.where(~F.col("asset_type").isin(named(exclude))) if named(exclude) else rows


def lifecycle_stats(findings: DataFrame, reason: str = "drop_reason") -> DataFrame:
    """Rows by drop reason (``kept`` if null), with the deprecated rule ids among them in order."""
    old = F.when(F.col("maturity") == "deprecated", F.col("rule_id"))
    return findings.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(old)), ",").alias("deprecated_rules"))


def group_subtree(spark: SparkSession, groups: DataFrame, root: int) -> DataFrame:
    """The root and all its descendants."""
    view = f"_keyloom_groups_{uuid.uuid4().hex}"
    groups.createOrReplaceTempView(view)
    out = spark.sql(f"WITH RECURSIVE t AS (SELECT group_id, 0 AS depth FROM {view} WHERE group_id = {int(root)} UNION ALL SELECT g.group_id, t.depth + 1 FROM {view} g JOIN t ON g.parent_group_id = t.group_id) SELECT group_id, depth FROM t")
    spark.catalog.dropTempView(view)
    return out


def search(findings: DataFrame, text: str, severity: str | None = None, quantum_status: str | None = None) -> DataFrame:
    """Case-insensitive literal substring of name, file or rule."""
    low = text.lower()
    hit = F.lower("name").contains(low) | F.lower("file").contains(low) | F.lower("rule_id").contains(low)
    hit = hit if severity is None else hit & (F.col("severity") == severity)
    return findings.where(hit if quantum_status is None else hit & (F.col("quantum_status") == quantum_status))


def fail_on(findings: DataFrame, threshold: str) -> DataFrame:
    return findings.where(X.severity_rank(F.col("severity")) >= X.SEVERITY_RANK[threshold]).groupBy("severity").agg(F.count("*").alias("n"))


def stale_projects(projects: DataFrame, scans: DataFrame, now: str, days: int) -> DataFrame:
    """Whole days since the last completed scan, where that is more than ``days`` (or there is none)."""
    last = scans.where("scan_status = 'completed'").groupBy("project_id").agg(F.max("completed_at").alias("last"))
    age = F.floor((F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("last")) / 86400)
    return projects.select("project_id").join(last, "project_id", "left").select("project_id", age.alias("days")).where(F.col("days").isNull() | (F.col("days") > days))


TRANSITIONS = (("open", "in_review"), ("open", "resolved"), ("open", "false_positive"), ("in_review", "resolved"), ("in_review", "open"), ("resolved", "open"), ("false_positive", "open"))


def validate_transitions(spark: SparkSession, changes: DataFrame) -> DataFrame:
    """``error`` of each change (old_status, new_status, reason): illegal pair first, then a missing reason."""
    legal = F.broadcast(spark.createDataFrame(list(TRANSITIONS), "old_status string, new_status string").withColumn("legal", F.lit(True)))
    j = changes.join(legal, ["old_status", "new_status"], "left")
    needs = F.col("new_status").isin("false_positive") & (F.coalesce("reason", F.lit("")) == "")
    return j.withColumn("error", F.when(F.col("legal").isNull(), "illegal").when(needs, "reason required")).drop("legal")


def scoreboard(emitted: DataFrame, truth: DataFrame, bucket: str, token: str) -> DataFrame:
    """TP, FP and FN of each bucket with recall and precision in percent."""
    e = emitted.select(bucket, token).distinct().withColumn("_e", F.lit(1))
    t = truth.select(bucket, token).distinct().withColumn("_t", F.lit(1))
    j = e.join(t, [bucket, token], "full_outer")
    by = j.groupBy(bucket).agg(F.count_if(F.col("_e").isNotNull() & F.col("_t").isNotNull()).alias("tp"), F.count_if(F.col("_t").isNull()).alias("fp"), F.count_if(F.col("_e").isNull()).alias("fn"))
    return by.select("*", X.rounded_percent(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), X.rounded_percent(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))
