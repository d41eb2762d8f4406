"""Roll-ups over all frameworks, scores of organisations, and analytics of rules over a window of time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions import crypto as X
from keyloom.operators import frameworks, portfolio


def portfolio_frameworks(findings: DataFrame) -> DataFrame:
    """Mean score, sums of what complies and what doesn't, and projects evaluated, for each of six frameworks. The two
    checklists score the share of their checks that pass; checks by hand count as neither.

    Findings are read once, summed by project and family, and every framework is a set of sums over those."""
    n, family, size = F.col("n"), F.col("family"), F.col("key_size")
    of = lambda met: F.sum(F.when(met, n).otherwise(0))
    nist = F.col("classification") == "acceptable"
    sums = {"nist-800-131a": of(nist), **{k: of(frameworks.classify(k, family, size) == f["good"]) for k, f in frameworks.FRAMEWORKS.items()}}
    lists = {"iso-27001-a8-24": (frameworks.iso_failures(family, size), len(frameworks.ISO_MANUAL)), "eu-cra": (frameworks.cra_gap_conditions(family, size), len(frameworks.CRA_MANUAL))}
    fails = {k: sum((F.coalesce(F.bool_or(c), F.lit(False)).cast("long") for c in bad), F.lit(0).cast("long")) for k, (bad, _) in lists.items()}
    by = portfolio.compliance_nist(findings).groupBy("project_id").agg(F.sum("n").alias("all"), F.sum(portfolio.penalty() * n).alias("p"), *(c.alias(k) for k, c in {**sums, **fails}.items()))

    rows = []
    for k in sums:
        good = F.col(f"`{k}`")
        score = portfolio.nist_score(F.col("p"), F.col("all")) if k == "nist-800-131a" else F.bround(good * 100.0 / F.col("all"), 1)
        rows.append(F.struct(F.lit(k).alias("framework"), score.alias("score"), good.alias("good"), (F.col("all") - good).alias("bad")))
    for k, (bad, manual) in lists.items():
        good = F.lit(len(bad)) - F.col(f"`{k}`")
        rows.append(F.struct(F.lit(k).alias("framework"), F.bround(good * 100.0 / (len(bad) + manual), 1).alias("score"), good.alias("good"), F.col(f"`{k}`").alias("bad")))
    each = by.select(F.inline(F.array(*rows)))
    return each.groupBy("framework").agg(F.bround(X.mean_score(F.col("score")), 1).alias("avg_score"), F.sum("good").alias("total_compliant"), F.sum("bad").alias("total_non_compliant"), F.count("*").alias("repos_evaluated"))


def summary_scores(findings: DataFrame, projects: DataFrame, groups: DataFrame, scans: DataFrame) -> DataFrame:
    """Per organisation: mean NIST score of the projects with findings, and its last completed scan."""
    score = portfolio.compliance_score(portfolio.compliance_nist(findings)).select("project_id", "score")
    last = scans.where("scan_status = 'completed'").groupBy("project_id").agg(F.max("completed_at").alias("last"))
    rows = projects.select("project_id", "group_id").join(groups.select("group_id", "org_id"), "group_id").join(score, "project_id", "left").join(last, "project_id", "left")
    return rows.groupBy("org_id").agg(F.bround(X.mean_score(F.col("score")), 1).alias("avg_nist_score"), F.max("last").alias("last_scan_at"))


def top_risk_percents(findings: DataFrame, n: int = 10) -> DataFrame:
    """The projects of highest risk with the share of exposed findings and of those that NIST accepts, all from one roll-up of
    projects and families."""
    fam = portfolio.compliance_nist(findings, F.sum(X.severity_weight(F.col("severity"))).alias("risk")).withColumn("posture", X.posture(F.col("family")))
    of = lambda met: F.sum(F.when(met, F.col("n")).otherwise(0))
    by = fam.groupBy("project_id").agg(F.sum("risk").alias("risk"), F.sum("n").alias("n"), of(F.col("posture").isin("broken", "vulnerable")).alias("x"), of(F.col("classification") == "acceptable").alias("good"))
    top = by.orderBy(F.desc("risk"), "project_id").limit(n)
    return top.select("project_id", "risk", X.rounded_percent(F.col("x"), F.col("n")).alias("quantum_risk_pct"), X.rounded_percent(F.col("good"), F.col("n")).alias("compliance_pct"))


def report_bundle(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """One row per completed scan: its findings by family with class, posture and migration target, the quantum risk, and the NIST and FIPS
    reports. A scan without findings has no risk and complies.

    All of it is one roll-up by scan and family; only families, never findings, are gathered into the row."""
    done = scans.where("scan_status = 'completed'").select("scan_id", "project_id", "completed_at")
    posture = X.posture(X.algorithm_family(F.col("name"), table=X.FAMILY_FULL))
    own = findings.withColumns({"project_id": F.col("scan_id"), "weight": portfolio.risk_weight(posture)})
    counts = [F.sum("weight").alias("raw"), *(F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in portfolio.SEVERITIES)]
    fam = portfolio.compliance_nist(own, *counts).withColumnsRenamed({"project_id": "of_scan", "classification": "nist"})
    fam = fam.withColumns({"posture": X.posture(F.col("family")), "fips": frameworks.classify("fips-140-3", F.col("family"), F.col("key_size"))})
    exposed = F.col("posture").isin("broken", "vulnerable")
    fam = fam.withColumn("target", F.when(exposed, X.lookup(F.col("family"), X.MIGRATION, "")))
    of = lambda met: F.sum(F.when(met, F.col("n")).otherwise(0))
    item = F.struct("family", "n", "key_size", "posture", "nist", "fips", "target")
    by = fam.groupBy("of_scan").agg(
        F.sum("n").alias("findings"), *(F.sum(f"n_{s}").alias(f"n_{s}") for s in portfolio.SEVERITIES), F.sum("raw").alias("raw"),
        of(F.col("posture") != "safe").alias("vulnerable"), of(F.col("posture") == "safe").alias("safe"), of(F.col("posture") == "broken").alias("broken"),
        F.sum(portfolio.penalty(F.col("nist")) * F.col("n")).alias("p"), of(F.col("nist") == "acceptable").alias("nist_compliant"), of(F.col("fips") == "approved").alias("fips_compliant"),
        F.array_sort(F.collect_list(item)).alias("families"))
    rows = done.join(by, done.scan_id == by.of_scan, "left")
    n = F.col("findings")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.select(
        "scan_id", "project_id", "completed_at", zero(n).alias("findings"), *(zero(F.col(f"n_{s}")).alias(f"n_{s}") for s in portfolio.SEVERITIES),
        F.when(n > 0, portfolio.risk_score(F.col("raw"), n)).otherwise(0.0).alias("quantum_risk"), *(zero(F.col(c)).alias(c) for c in ("vulnerable", "safe", "broken")),
        F.when(n > 0, portfolio.nist_score(F.col("p"), n)).otherwise(100.0).alias("nist_score"), zero(F.col("nist_compliant")).alias("nist_compliant"), F.when(n > 0, X.rounded_percent(F.col("fips_compliant"), n)).otherwise(100.0).alias("fips_score"), zero(F.col("fips_compliant")).alias("fips_compliant"), "families")


def window_days(text: str, default: int = 90) -> int:
    """Days of a window like ``30d``."""
    text = text.strip().lower()
    return int(text[:-1]) if text.endswith("d") and text[:-1].isdigit() else default


def rule_analytics(findings: DataFrame, history: DataFrame, window: str, now: str) -> DataFrame:
    """Findings of each rule created within the window: rates of false positives, accepted risks and fixes, and the mean seconds from
    creation to the latest resolution of those that are resolved. ``history``: finding_id, new_status, changed_at."""
    since = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {window_days(window)} DAYS")
    rows = findings.where(F.col("created_at").cast("timestamp") >= since)
    resolved = history.where("new_status = 'resolved'").groupBy("finding_id").agg(F.max("changed_at").alias("resolved_at"))
    rows = rows.join(resolved, "finding_id", "left")
    took = F.when(F.col("status") == "resolved", F.unix_timestamp("resolved_at") - F.unix_timestamp(F.col("created_at").cast("timestamp")))
    s = F.col("status")
    by = rows.groupBy("rule_id").agg(F.count("*").alias("total"), F.count_if(s.isin("open", "in_review", "in_progress")).alias("active"), F.count_if(s == "false_positive").alias("fp"), F.count_if(s == "risk_accepted").alias("ra"), F.count_if(s == "resolved").alias("fixed"), F.avg(took).alias("t"))
    rate = lambda c: X.rounded_percent(F.col(c), F.col("total"), 2)
    return by.select("rule_id", "total", "active", rate("fp").alias("fp_rate"), rate("ra").alias("ra_rate"), rate("fixed").alias("fix_rate"), F.bround("t", 2).alias("mttr_seconds"))


def rule_trend(findings: DataFrame, scans: DataFrame, rule_id: str) -> DataFrame:
    """A rule's findings in each scan, oldest scan first."""
    by = findings.where(F.col("rule_id") == rule_id).groupBy("scan_id").agg(F.count("*").alias("n"))
    return by.join(scans.select("scan_id", F.col("completed_at").alias("scanned_at")), "scan_id").orderBy("scanned_at", "scan_id")


def threshold_report(findings: DataFrame, threshold: str, examples: int = 5) -> DataFrame:
    """Of the findings at or above a severity: the first ones by severity, file, line and id, and how many more there are."""
    rows = findings.where(X.severity_rank(F.col("severity")) >= X.SEVERITY_RANK[threshold])
    total = rows.agg(F.count("*").alias("total"))
    first = rows.orderBy(F.desc(X.severity_rank(F.col("severity"))), "file", "line", "finding_id").limit(examples)
    return first.crossJoin(total).select("finding_id", "severity", "file", "line", F.greatest(F.lit(0), F.col("total") - examples).alias("remainder"))
