"""Joins around an inventory: SBOM components, effective roles, scan schedules, notifications, generic issues."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions import crypto as X

# Rank of a role, severity of a notification's trigger, issue severities.
ROLE_RANK = {"guest": 0, "developer": 1, "compliance_auditor": 2, "team_manager": 3, "security_engineer": 4, "security_manager": 5, "org_admin": 6}
TRIGGER_SEVERITY = {"scan_completed": "info", "scan_violations": "high", "critical_finding": "critical", "cert_expiry_30d": "high", "suppression_submitted": "medium"}
ISSUE_SEVERITY = {"critical": "CRITICAL", "high": "MAJOR", "medium": "MINOR"}
ISSUE_IMPACT = {"critical": "HIGH", "high": "HIGH", "medium": "MEDIUM"}


#: Characters of a gram, and how many needles of a key are looked for in each of its texts.
GRAM, FEW = 4, 32


def grams(*texts: Column) -> Column:
    """The distinct grams of texts; a null one has none."""
    of = lambda t: F.when(F.length(t) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(t) - (GRAM - 1)), lambda i: F.substr(t, i, F.lit(GRAM)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*(of(F.coalesce(t, F.lit(""))) for t in texts)))


def candidates(parts: DataFrame, texts: DataFrame, key: str, needle: Column, fields: list[str]) -> DataFrame:
    """Pairs of a part and a text of the same ``key`` that can hold the needle. Columns of the parts keep their names.

    A key's needles are looked for in its texts as they pass, while there are at most ``FEW`` of them; a key with more is looked up in the texts'
    grams by each needle's first one, and only that key's texts are taken apart. Needles shorter than a gram are always looked for. A text
    travels once, with nothing but what it holds."""
    rows = parts.withColumn("_needle", needle).where("_needle IS NOT NULL")
    many = rows.groupBy(key).agg(F.countDistinct("_needle").alias("_n"))
    rows = rows.join(many, key).withColumn("_many", F.col("_n") > FEW).drop("_n")
    indexed = F.col("_many") & (F.length("_needle") >= GRAM)
    rows = rows.withColumn("_at", F.when(indexed, F.concat(F.lit("~"), F.substring("_needle", 1, GRAM))).otherwise(F.concat(F.lit("="), F.col("_needle"))))
    own = rows.groupBy(key).agg(F.collect_set(F.when(~indexed, F.col("_needle"))).alias("_needles"), F.bool_or(indexed).alias("_grams"))
    holds = lambda n: reduce(or_, (F.coalesce(F.contains(F.lower(f), n), F.lit(False)) for f in fields))
    found = F.transform(F.filter("_needles", holds), lambda n: F.concat(F.lit("="), n))
    taken = F.when(F.col("_grams"), F.transform(grams(*(F.lower(f) for f in fields)), lambda g: F.concat(F.lit("~"), g))).otherwise(F.array().cast("array<string>"))
    met = texts.join(own, key).select(*texts.columns, F.explode(F.concat(found, taken)).alias("_at"))
    return met.join(rows.drop("_many"), [key, "_at"]).drop("_at")


def sbom_links(components: DataFrame, findings: DataFrame) -> DataFrame:
    """Components (project_id, sbom_id, created_at, name) of each project's latest SBOM with the findings whose name or file contains the component's.

    Components are counted by name first; findings meet them by :func:`candidates`.
    """
    last = components.groupBy("project_id").agg(F.max_by("sbom_id", F.struct("created_at", "sbom_id")).alias("sbom_id"))
    parts = components.join(last, ["project_id", "sbom_id"]).groupBy("project_id", F.col("name").alias("library")).agg(F.count("*").alias("times"))
    texts = findings.select("project_id", "name", "file")
    holds = lambda c: F.coalesce(F.contains(F.lower(c), F.col("_needle")), F.lit(False))
    hits = candidates(parts, texts, "project_id", F.lower("library"), ["name", "file"]).where(holds("name") | holds("file"))
    by = hits.groupBy(F.col("project_id").alias("p"), F.col("library").alias("l")).agg(F.sum("times").alias("n"), F.collect_set("name").alias("names"))
    met = parts.join(by, (F.col("project_id") == F.col("p")) & (F.col("library") == F.col("l")), "left")
    return met.select("project_id", "library", F.coalesce("n", F.lit(0).cast("long")).alias("findings_count"), F.array_join(F.sort_array(F.coalesce("names", F.array().cast("array<string>"))), ",").alias("crypto_findings"))


def effective_role(own: Column, in_group: Column) -> Column:
    """The higher of both roles; an unknown one ranks 0 and a tie keeps the user's own."""
    rank = lambda c: X.lookup(c, ROLE_RANK, 0)
    return F.when(in_group.isNull() | (rank(own) >= rank(in_group)), own).otherwise(in_group)


def effective_roles(users: DataFrame, memberships: DataFrame) -> DataFrame:
    """users (user_id, role) and memberships (user_id, group_id, group_role): the role in each group, or without one."""
    return users.join(memberships, "user_id", "left").select("user_id", "group_id", effective_role(F.col("role"), F.col("group_role")).alias("role"))


def schedules(projects: DataFrame, groups: DataFrame, orgs: DataFrame) -> DataFrame:
    """The schedule of every project: its own, else its group's, else its organisation's; an empty one is none."""
    rows = projects.join(groups, "group_id", "left").join(orgs, "org_id", "left")
    own, group, org = (F.nullif(F.col(c), F.lit("")) for c in ("project_cron", "group_cron", "org_cron"))
    source = F.when(own.isNotNull(), "project").when(group.isNotNull(), "group").when(org.isNotNull(), "org").otherwise("none")
    return rows.select("project_id", F.coalesce(own, group, org).alias("cron"), source.alias("source"))


def fan_out(events: DataFrame, prefs: DataFrame) -> DataFrame:
    """One in-app message for each user of an event (event_id, trigger, title, user_ids) whose preference does not forbid it. Works on streams too."""
    rows = events.select("event_id", "trigger", "title", F.explode("user_ids").alias("user_id"))
    severity = X.lookup(F.col("trigger"), TRIGGER_SEVERITY, "info")
    wanted = rows.join(prefs, ["user_id", "trigger"], "left").where("coalesce(in_app, true)")
    return wanted.select("event_id", "user_id", "trigger", severity.alias("severity"), F.concat(F.lit("["), F.upper(severity), F.lit("] "), F.col("title")).alias("subject"))


def _rule(tool: str) -> Column:
    return F.coalesce(F.nullif(F.col("rule_id"), F.lit("")), F.concat(F.lit(f"{tool}-"), F.lower("asset_type")))


def issues(findings: DataFrame, tool: str) -> DataFrame:
    """Generic issues: rule, severity, effort, and the line where there is one."""
    return findings.select("finding_id", _rule(tool).alias("rule"), X.lookup(F.col("severity"), ISSUE_SEVERITY, "INFO").alias("issue_severity"), X.effort_minutes(F.col("severity")).alias("effort"), "file", F.when(F.col("line") > 0, F.col("line")).alias("start_line"))


def issue_rules(findings: DataFrame, tool: str, order: list[str]) -> DataFrame:
    """Each scan's rules once; the first finding supplies name and impact."""
    first = F.min_by(F.struct("name", "severity"), F.struct(*order))
    by = findings.withColumn("rule", _rule(tool)).groupBy("scan_id", "rule").agg(first.alias("f"))
    return by.select("scan_id", "rule", F.col("f.name").alias("name"), X.lookup(F.col("f.severity"), ISSUE_IMPACT, "LOW").alias("impact"))
