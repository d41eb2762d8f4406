"""Portfolio roll-ups: counts by project and family, risk, compliance, migration and agility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions import crypto as X

SEVERITIES = ("critical", "high", "medium", "low", "info")


def with_family(findings: DataFrame, table=X.FAMILY_FULL) -> DataFrame:
    return findings.withColumn("family", X.algorithm_family(F.col("name"), table=table))


def with_posture(findings: DataFrame) -> DataFrame:
    return with_family(findings).withColumn("posture", X.posture(F.col("family")))


def severity_counts() -> list:
    return [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]


def summary(findings: DataFrame, projects: DataFrame, groups: DataFrame) -> DataFrame:
    """Per organisation: projects with findings, severities, readiness and exposure in percent."""
    by = with_posture(findings).groupBy("project_id").agg(F.count("*").alias("n"), *severity_counts(), F.count_if(F.col("posture") == "safe").alias("n_safe"), F.count_if(F.col("posture").isin("broken", "vulnerable")).alias("n_exposed"))
    rows = by.join(projects, "project_id").join(groups, "group_id")
    out = rows.groupBy("org_id").agg(F.count("*").alias("projects"), F.sum("n").alias("findings"), *(F.sum(f"n_{s}").alias(f"n_{s}") for s in SEVERITIES), F.sum("n_safe").alias("safe"), F.sum("n_exposed").alias("exposed"), F.count_if(F.col("n_critical") + F.col("n_high") > 0).alias("affected"))
    return out.select("*", X.rounded_percent(F.col("safe"), F.col("findings"), empty=100.0).alias("readiness_pct"), X.rounded_percent(F.col("exposed"), F.col("findings")).alias("exposed_pct"))


def top_risk(findings: DataFrame, n: int = 10) -> DataFrame:
    """Projects by the sum of severity weights."""
    by = findings.groupBy("project_id").agg(F.sum(X.severity_weight(F.col("severity"))).alias("risk"), F.count("*").alias("findings"))
    return by.orderBy(F.desc("risk"), "project_id").limit(n)


def quantum_counts(findings: DataFrame) -> DataFrame:
    """Broken ones count as vulnerable too."""
    p = F.col("posture")
    return with_posture(findings).agg(F.count("*").alias("total"), F.count_if(p == "broken").alias("broken"), F.count_if(p.isin("broken", "vulnerable")).alias("vulnerable"), F.count_if(p == "safe").alias("safe"), F.count_if(p == "unknown").alias("unknown"))


def migration_priority(findings: DataFrame) -> DataFrame:
    by = with_posture(findings).where("posture IN ('broken', 'vulnerable')").groupBy("family").agg(F.count("*").alias("findings"), F.countDistinct("project_id").alias("repos"))
    return by.select("*", X.lookup(F.col("family"), X.MIGRATION, "").alias("target"), F.row_number().over(W.orderBy(F.desc("findings"), "family")).alias("priority"))


def risk_weight(posture):
    """Severity weight times exposure of a finding."""
    factor = F.when(posture == "broken", 2.0).when(posture == "vulnerable", 1.0).when(posture == "safe", 0.0).otherwise(0.5)
    return X.lookup(F.lower("severity"), {k: v for k, v in X.SEVERITY_WEIGHT.items() if k != "info"}, 4.0) * factor


def risk_score(raw, findings):
    """0 to 100: the weights over the most that is possible."""
    return F.least(F.lit(100.0), F.bround(F.try_divide(raw * 100.0, findings * 20.0), 1))


def quantum_risk(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Score of each key."""
    p = F.col("posture")
    by = with_posture(findings).groupBy(*keys).agg(F.sum(risk_weight(p)).alias("raw"), F.count("*").alias("n"), F.count_if(p != "safe").alias("vulnerable"), F.count_if(p == "safe").alias("safe"), F.count_if(p == "broken").alias("broken"))
    return by.select(*keys, risk_score(F.col("raw"), F.col("n")).alias("score"), "vulnerable", "safe", "broken")


# Family, classification, least and most key size, order within the family.
NIST = (
    ("des", "disallowed", None, None), ("3des", "disallowed", None, None), ("rc4", "disallowed", None, None), ("md5", "disallowed", None, None), ("sha1", "disallowed", None, None),
    ("rsa", "disallowed", None, 2047), ("rsa", "deprecated", 2048, None), ("ecdsa", "deprecated", None, None), ("ecdh", "deprecated", None, None), ("ecc", "deprecated", None, None),
    ("dh", "deprecated", 2048, None), ("dsa", "deprecated", None, None), ("aes", "acceptable", 128, None), ("sha256", "acceptable", None, None), ("sha384", "acceptable", None, None),
    ("sha512", "acceptable", None, None), ("sha3-256", "acceptable", None, None), ("sha3-384", "acceptable", None, None), ("sha3-512", "acceptable", None, None),
    ("ml-kem", "acceptable", None, None), ("ml-dsa", "acceptable", None, None), ("slh-dsa", "acceptable", None, None),
)


def nist_class(family, size):
    """Classification of a family at a key size: a sized rule where several fit, below a least size disallowed, else the first rule."""
    by: dict[str, list] = {}
    for f, c, low, high in NIST:
        by.setdefault(f, []).append((c, low, high))
    out = F.lit("unknown")
    for f, rules in by.items():
        own = F.lit(rules[0][0])
        least = [low for _, low, _ in rules if low is not None]
        if least:
            own = F.when(size < min(least), "disallowed").otherwise(own)
        if len(rules) > 1:
            for c, low, high in reversed(rules):
                own = F.when(size <= high if high is not None else size >= low, c).otherwise(own)
        out = F.when(family == f, own).otherwise(out)
    return out


def compliance_nist(findings: DataFrame, *more) -> DataFrame:
    """Families of each project by class; the family's size is that of its first finding, null included. ``more``: further
    aggregates of a project's family."""
    first = F.min_by(F.struct("key_size"), F.struct("scan_id", "seq", "part", "supp"))
    by = with_family(findings).groupBy("project_id", "family").agg(F.count("*").alias("n"), first.alias("f"), *more)
    return by.select("project_id", "family", "n", F.col("f.key_size").alias("key_size"), nist_class(F.col("family"), F.col("f.key_size")).alias("classification"), *by.columns[4:])


def penalty(classification=None):
    """3, 1 and 0.5 for disallowed, deprecated and unknown."""
    return X.lookup(F.col("classification") if classification is None else classification, {"disallowed": 3.0, "deprecated": 1.0, "unknown": 0.5}, 0.0)


def nist_score(penalties, findings):
    """100 less the penalties over three a finding."""
    return F.greatest(F.lit(0.0), F.bround(100.0 - F.try_divide(penalties * 100.0, 3.0 * findings), 1))


def compliance_score(nist: DataFrame) -> DataFrame:
    by = nist.groupBy("project_id").agg(F.sum("n").alias("findings"), F.sum(penalty() * F.col("n")).alias("p"))
    return by.select("project_id", "findings", nist_score(F.col("p"), F.col("findings")).alias("score"))


def pqc_overview(findings: DataFrame) -> DataFrame:
    c = quantum_counts(findings)
    return c.select("total", "vulnerable", "safe", "unknown", *(X.rounded_percent(F.col(x), F.col("total"), 2).alias(f"{x}_pct") for x in ("vulnerable", "safe", "unknown")))


def pqc_families(findings: DataFrame) -> DataFrame:
    p = F.col("posture")
    by = with_posture(findings).groupBy("family").agg(F.count("*").alias("total"), F.count_if(p.isin("broken", "vulnerable")).alias("vulnerable"), F.count_if(p == "safe").alias("migrated"))
    return by.select("*", X.rounded_percent(F.col("migrated"), F.col("total"), 2).alias("migrated_pct"))


def pqc_lagging(findings: DataFrame, n: int = 10) -> DataFrame:
    by = with_posture(findings).groupBy("project_id").agg(F.count("*").alias("total"), F.count_if(F.col("posture").isin("broken", "vulnerable")).alias("vulnerable"))
    return by.where("vulnerable > 0").select("*", X.rounded_percent(F.col("vulnerable"), F.col("total"), 2).alias("vulnerable_pct")).orderBy(F.desc("vulnerable_pct"), "project_id").limit(n)


def hndl_risk(findings: DataFrame, projects: DataFrame, year: int, deadline: int = 2035, horizon: int = 15, places: int = 4) -> DataFrame:
    """Harvest-now-decrypt-later risk: sensitivity times exposure times time factor; Mosca's inequality."""
    exposure = X.lookup(F.col("posture"), {"safe": 0.0, "unknown": 0.5}, 1.0)
    by = with_posture(findings).groupBy("project_id").agg((F.max(exposure) * 0.7 + F.avg(exposure) * 0.3).alias("exposure"))
    sensitivity = X.lookup(F.col("classification"), {"public": 0.1, "internal": 0.4, "confidential": 0.7, "restricted": 1.0}, 0.4)
    shelf = X.lookup(F.col("classification"), {"public": 1, "internal": 5, "confidential": 15, "restricted": 25}, 5)
    factor = min(1.0, max(0.0, 1 - max(0, deadline - year) / horizon))
    risk = sensitivity * F.col("exposure") * factor
    mosca = shelf + 3 > max(0, deadline - year)
    urgency = F.when((risk >= 0.8) | (mosca & (F.col("exposure") > 0)), "URGENT").when(risk >= 0.5, "HIGH").when(risk >= 0.2, "MEDIUM").otherwise("LOW")
    return by.join(projects, "project_id").select("project_id", "classification", F.bround("exposure", places).alias("exposure"), F.bround(risk, places).alias("risk"), mosca.alias("mosca"), urgency.alias("urgency"))


def step(value, steps: list[tuple[float, float]], last: float):
    """The first score whose bound the value doesn't exceed."""
    out = F.lit(last)
    for bound, score in reversed(steps):
        out = F.when(value <= bound, score).otherwise(out)
    return out


def heatmap(findings: DataFrame, projects: DataFrame) -> DataFrame:
    by = findings.groupBy("project_id").agg(*severity_counts())
    return projects.select("project_id").join(by, "project_id", "left").na.fill(0)


def scan_summary(findings: DataFrame) -> DataFrame:
    """Counts by severity, posture, asset type and family in one pass of grouping sets."""
    dims = ("severity", "posture", "asset_type", "family")
    rows = with_posture(findings).select(*dims)
    out = rows.groupingSets([[F.col(d)] for d in dims], *(F.col(d) for d in dims)).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    which = F.when(F.col("g") == 7, "severity").when(F.col("g") == 11, "posture").when(F.col("g") == 13, "asset_type").otherwise("family")
    return out.select(which.alias("dimension"), F.coalesce(*dims).alias("value"), "n")


def top_algorithms(findings: DataFrame, n: int = 10) -> DataFrame:
    return findings.where("asset_type = 'algorithm'").groupBy("name").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files")).orderBy(F.desc("n"), "name").limit(n)


def first_examples(findings: DataFrame) -> DataFrame:
    """First finding of each severity by (file, line, id)."""
    return findings.groupBy("severity").agg(F.count("*").alias("n"), F.min(F.struct("file", "line", "finding_id")).alias("f")).select("severity", "n", "f.file", "f.line", "f.finding_id")


def family_rollup(findings: DataFrame) -> DataFrame:
    rank = X.lookup(F.col("posture"), {"broken": 0, "vulnerable": 1, "unknown": 2}, 3)
    by = with_posture(findings).groupBy("family").agg(F.min(rank).alias("worst"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))
    return by.select("family", X.lookup(F.col("worst"), {0: "broken", 1: "vulnerable", 2: "unknown"}, "safe").alias("status"), "n", "names")


def migration_backlog(findings: DataFrame, top: int = 20, examples: int = 3) -> DataFrame:
    rows = with_posture(findings).where("posture IN ('broken', 'vulnerable')")
    where_ = F.concat_ws(":", "file", F.col("line").cast("string"))
    places = rows.select("family", where_.alias("place")).distinct().withColumn("k", F.row_number().over(W.partitionBy("family").orderBy("place"))).where(F.col("k") <= examples)
    text = places.groupBy("family").agg(F.array_join(F.array_sort(F.collect_list("place")), " ").alias("examples"))
    return rows.groupBy("family").agg(F.count("*").alias("n")).join(text, "family").orderBy(F.desc("n"), "family").limit(top)


def histogram(values: DataFrame, value: str, bounds: tuple[float, ...]) -> DataFrame:
    """Cumulative ``le`` buckets in one aggregation; null values are in none."""
    counts = values.agg(*(F.count_if(F.col(value) <= b).alias(str(i)) for i, b in enumerate(bounds)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(bounds)))))


def project_overview(projects: DataFrame, groups: DataFrame, scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Every project with its group, last completed scan and number of findings in completed scans."""
    done = scans.where("scan_status = 'completed'")
    last = done.groupBy("project_id").agg(F.max(F.struct("completed_at", "scan_id")).alias("l"), F.count("*").alias("completed_scans"))
    n = findings.join(done.select("scan_id"), "scan_id", "left_semi").groupBy("project_id").agg(F.count("*").alias("findings"))
    rows = projects.join(groups, "group_id", "left").join(last, "project_id", "left").join(n, "project_id", "left")
    zero = F.lit(0).cast("long")
    return rows.select("project_id", "project", "group_name", F.col("l.scan_id").alias("last_scan"), F.coalesce("completed_scans", zero).alias("completed_scans"), F.coalesce("findings", zero).alias("findings"))


def group_counts(groups: DataFrame, projects: DataFrame) -> DataFrame:
    n = projects.groupBy("group_id").agg(F.count("*").alias("projects"))
    return groups.select("group_id", "group_name").join(n, "group_id", "left").na.fill(0)


def runtime_summary(observations: DataFrame) -> DataFrame:
    return observations.groupBy("project_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("tls_version")), ",").alias("versions"), F.array_join(F.array_sort(F.collect_set("service_name")), ",").alias("services"))


def latest_service_state(observations: DataFrame) -> DataFrame:
    best = F.max(F.struct("observed_at", "event_id", "tls_version")).alias("l")
    return observations.groupBy("project_id", "service_name").agg(best).select("project_id", "service_name", "l.tls_version", "l.event_id")


def rule_analytics(findings: DataFrame) -> DataFrame:
    s = F.col("status")
    by = findings.groupBy("rule_id").agg(F.count("*").alias("total"), F.count_if(s == "false_positive").alias("false_positives"), F.count_if(s == "resolved").alias("fixed"))
    out = by.select("*", X.rounded_percent(F.col("false_positives"), F.col("total"), 2).alias("fp_pct"), X.rounded_percent(F.col("fixed"), F.col("total"), 2).alias("fix_pct"))
    return out.withColumn("warning", (F.col("fp_pct") > 50) | (F.col("fix_pct") < 10))


def daily_counts(observations: DataFrame) -> DataFrame:
    day = F.date_format(F.date_trunc("day", "observed_at"), "yyyy-MM-dd")
    return observations.groupBy(day.alias("day"), "service_name").agg(F.count("*").alias("n"), F.count_if(F.col("tls_version").isin("1.2", "1.3")).alias("compliant"))
