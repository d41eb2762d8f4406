"""All queries of the inventory engine over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions import crypto as X
from keyloom.functions import normalise as N
from keyloom.operators import detect, drift, frameworks, links, policy, portfolio
from keyloom.sources import adapters as A
from keyloom.sources import documents as D

YEAR, NOW = 2026, "1998-12-01 00:00:00"

_FAMILY = "CASE " + " ".join(f"WHEN contains(lower(name), '{k}') THEN '{v}'" for k, v in X.FAMILY_FULL) + " ELSE 'unknown' END"
_LITE = "CASE " + " ".join(f"WHEN contains(lower(name), '{k}') THEN '{v}'" for k, v in X.FAMILY_LITE) + " ELSE 'unknown' END"
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
_POSTURE = f"CASE WHEN family IN {_IN(X.BROKEN)} THEN 'broken' WHEN family IN {_IN(X.VULNERABLE)} THEN 'vulnerable' WHEN family IN {_IN(X.SAFE)} THEN 'safe' ELSE 'unknown' END"
_WEIGHT = "CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 7.0 WHEN 'medium' THEN 4.0 WHEN 'low' THEN 1.0 ELSE {} END"
_MAP = lambda col, t, d: f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items()) + f" ELSE {d} END"
_PCT = lambda a, b, n=1, e="0.0": f"CASE WHEN {b} = 0 THEN {e} ELSE round_even(CAST({a} AS DOUBLE) * 100.0 / {b}, {n}) END"
_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS n_{s}" for s in portfolio.SEVERITIES)

WITH = f"WITH {A.SQL}, ff AS (SELECT *, {_FAMILY} AS family FROM findings), fp AS (SELECT *, {_POSTURE} AS posture FROM ff) "

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, plain: bool = False):
    """Register a function of (spark, sf_dir); ``sql`` is put behind the domain tables unless ``plain``."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql if plain else WITH + sql
        return f

    return keep


# --- portfolio and risk -------------------------------------------------------------------------------------


@query(f"""SELECT *, {_PCT('safe', 'findings', 1, '100.0')} AS readiness_pct, {_PCT('exposed', 'findings')} AS exposed_pct FROM (
SELECT org_id, count(*) AS projects, CAST(sum(n) AS BIGINT) AS findings, {', '.join(f'CAST(sum(n_{s}) AS BIGINT) AS n_{s}' for s in portfolio.SEVERITIES)}, CAST(sum(n_safe) AS BIGINT) AS safe, CAST(sum(n_exp) AS BIGINT) AS exposed, count(*) FILTER (n_critical + n_high > 0) AS affected FROM (
SELECT project_id, count(*) AS n, {_COUNTS}, count(*) FILTER (posture = 'safe') AS n_safe, count(*) FILTER (posture IN ('broken', 'vulnerable')) AS n_exp FROM fp GROUP BY 1) JOIN projects USING (project_id) JOIN groups USING (group_id) GROUP BY org_id)""")
def portfolio_summary(spark, d):
    return portfolio.summary(A.findings(spark, d), A.projects(spark, d), A.groups(spark, d))


@query(f"SELECT project_id, CAST(sum({_WEIGHT.format('0.0')}) AS DOUBLE) AS risk, count(*) AS findings FROM findings GROUP BY 1 ORDER BY risk DESC, project_id LIMIT 10")
def portfolio_top_risk(spark, d):
    return portfolio.top_risk(A.findings(spark, d))


@query("SELECT count(*) AS total, count(*) FILTER (posture = 'broken') AS broken, count(*) FILTER (posture IN ('broken', 'vulnerable')) AS vulnerable, count(*) FILTER (posture = 'safe') AS safe, count(*) FILTER (posture = 'unknown') AS unknown FROM fp")
def portfolio_quantum(spark, d):
    return portfolio.quantum_counts(A.findings(spark, d))


@query(f"SELECT *, {_MAP('family', X.MIGRATION, chr(39) * 2)} AS target, CAST(row_number() OVER (ORDER BY findings DESC, family) AS INTEGER) AS priority FROM (SELECT family, count(*) AS findings, count(DISTINCT project_id) AS repos FROM fp WHERE posture IN ('broken', 'vulnerable') GROUP BY 1)")
def portfolio_migration(spark, d):
    return portfolio.migration_priority(A.findings(spark, d))


@query(f"SELECT project_id, {', '.join(f'coalesce(n_{s}, 0) AS n_{s}' for s in portfolio.SEVERITIES)} FROM projects LEFT JOIN (SELECT project_id, {_COUNTS} FROM findings GROUP BY 1) USING (project_id)")
def portfolio_heatmap(spark, d):
    return portfolio.heatmap(A.findings(spark, d), A.projects(spark, d))


@query(f"""SELECT project_id, least(100.0, round_even(CAST(raw AS DOUBLE) * 100.0 / (n * 20.0), 1)) AS score, vulnerable, safe, broken FROM (SELECT project_id, sum(({_WEIGHT.format('4.0')}) * CASE posture WHEN 'broken' THEN 2.0 WHEN 'vulnerable' THEN 1.0 WHEN 'safe' THEN 0.0 ELSE 0.5 END) AS raw, count(*) AS n,
count(*) FILTER (posture <> 'safe') AS vulnerable, count(*) FILTER (posture = 'safe') AS safe, count(*) FILTER (posture = 'broken') AS broken FROM fp GROUP BY 1)""")
def risk_quantum(spark, d):
    return portfolio.quantum_risk(A.findings(spark, d), ["project_id"])


_NIST = """CASE WHEN family IN ('des', '3des', 'rc4', 'md5', 'sha1') THEN 'disallowed' WHEN family = 'rsa' THEN CASE WHEN key_size >= 2048 THEN 'deprecated' ELSE 'disallowed' END WHEN family = 'dh' THEN CASE WHEN key_size < 2048 THEN 'disallowed' ELSE 'deprecated' END
WHEN family IN ('ecdsa', 'ecdh', 'ecc', 'dsa') THEN 'deprecated' WHEN family = 'aes' THEN CASE WHEN key_size < 128 THEN 'disallowed' ELSE 'acceptable' END WHEN family IN ('sha256', 'sha384', 'sha512', 'sha3-256', 'sha3-384', 'sha3-512', 'ml-kem', 'ml-dsa', 'slh-dsa') THEN 'acceptable' ELSE 'unknown' END"""
_NISTED = f"nist AS (SELECT project_id, family, n, key_size, {_NIST} AS classification FROM (SELECT project_id, family, count(*) OVER (PARTITION BY project_id, family) AS n, key_size, row_number() OVER (PARTITION BY project_id, family ORDER BY scan_id, seq, part, supp) AS k FROM ff) WHERE k = 1)"


def _more(sql: str) -> str:
    return WITH.rstrip() + ", " + _NISTED + " " + sql


@query(_more("SELECT project_id, family, n, coalesce(key_size, -1) AS key_size, classification FROM nist"), plain=True)
def compliance_nist(spark, d):
    return portfolio.compliance_nist(A.findings(spark, d)).na.fill(-1, ["key_size"])


@query(_more("SELECT project_id, findings, greatest(0.0, round_even(100.0 - CAST(p AS DOUBLE) * 100.0 / (3.0 * findings), 1)) AS score FROM (SELECT project_id, CAST(sum(n) AS BIGINT) AS findings, sum(n * CASE classification WHEN 'disallowed' THEN 3.0 WHEN 'deprecated' THEN 1.0 WHEN 'unknown' THEN 0.5 ELSE 0.0 END) AS p FROM nist GROUP BY 1)"), plain=True)
def compliance_scores(spark, d):
    return portfolio.compliance_score(portfolio.compliance_nist(A.findings(spark, d)))


@query(f"SELECT *, {', '.join(f'{_PCT(x, chr(116) + chr(111) + chr(116) + chr(97) + chr(108), 2)} AS {x}_pct' for x in ('vulnerable', 'safe', 'unknown'))} FROM (SELECT count(*) AS total, count(*) FILTER (posture IN ('broken', 'vulnerable')) AS vulnerable, count(*) FILTER (posture = 'safe') AS safe, count(*) FILTER (posture = 'unknown') AS unknown FROM fp)")
def risk_pqc_overview(spark, d):
    return portfolio.pqc_overview(A.findings(spark, d))


@query(f"SELECT *, {_PCT('migrated', 'total', 2)} AS migrated_pct FROM (SELECT family, count(*) AS total, count(*) FILTER (posture IN ('broken', 'vulnerable')) AS vulnerable, count(*) FILTER (posture = 'safe') AS migrated FROM fp GROUP BY 1)")
def risk_pqc_families(spark, d):
    return portfolio.pqc_families(A.findings(spark, d))


@query(f"SELECT * FROM (SELECT *, {_PCT('vulnerable', 'total', 2)} AS vulnerable_pct FROM (SELECT project_id, count(*) AS total, count(*) FILTER (posture IN ('broken', 'vulnerable')) AS vulnerable FROM fp GROUP BY 1) WHERE vulnerable > 0) ORDER BY vulnerable_pct DESC, project_id LIMIT 10")
def risk_pqc_lagging(spark, d):
    return portfolio.pqc_lagging(A.findings(spark, d))


@query()
def risk_hndl(spark, d):
    return portfolio.hndl_risk(A.findings(spark, d), A.projects(spark, d), YEAR, places=8)


@query("""SELECT 'severity' AS dimension, severity AS value, count(*) AS n FROM fp GROUP BY severity UNION ALL SELECT 'posture', posture, count(*) FROM fp GROUP BY posture UNION ALL SELECT 'asset_type', asset_type, count(*) FROM fp GROUP BY asset_type UNION ALL SELECT 'family', family, count(*) FROM fp GROUP BY family""")
def portfolio_scan_summary(spark, d):
    return portfolio.scan_summary(A.findings(spark, d))


@query("SELECT name, count(*) AS n, count(DISTINCT file) AS files FROM findings WHERE asset_type = 'algorithm' GROUP BY 1 ORDER BY n DESC, name LIMIT 10")
def portfolio_top_algorithms(spark, d):
    return portfolio.top_algorithms(A.findings(spark, d))


@query("SELECT severity, n, file, line, finding_id FROM (SELECT severity, count(*) OVER (PARTITION BY severity) AS n, file, line, finding_id, row_number() OVER (PARTITION BY severity ORDER BY file, line, finding_id) AS k FROM findings) WHERE k = 1")
def portfolio_first_examples(spark, d):
    return portfolio.first_examples(A.findings(spark, d))


@query("SELECT family, CASE min(CASE posture WHEN 'broken' THEN 0 WHEN 'vulnerable' THEN 1 WHEN 'unknown' THEN 2 ELSE 3 END) WHEN 0 THEN 'broken' WHEN 1 THEN 'vulnerable' WHEN 2 THEN 'unknown' ELSE 'safe' END AS status, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM fp GROUP BY family")
def portfolio_family_rollup(spark, d):
    return portfolio.family_rollup(A.findings(spark, d))


@query("""SELECT family, n, examples FROM (SELECT family, count(*) AS n FROM fp WHERE posture IN ('broken', 'vulnerable') GROUP BY 1) JOIN (SELECT family, string_agg(place, ' ' ORDER BY place) AS examples FROM (SELECT family, place, row_number() OVER (PARTITION BY family ORDER BY place) AS k FROM (SELECT DISTINCT family, file || ':' || line AS place FROM fp WHERE posture IN ('broken', 'vulnerable'))) WHERE k <= 3 GROUP BY 1) USING (family) ORDER BY n DESC, family LIMIT 20""")
def portfolio_backlog(spark, d):
    return portfolio.migration_backlog(A.findings(spark, d))


@query("SELECT le, count(*) FILTER (value <= le) AS n FROM events, (SELECT unnest([1.0, 5.0, 10.0, 50.0, 100.0, 500.0])::DOUBLE AS le) GROUP BY le", plain=True)
def portfolio_histogram(spark, d):
    return portfolio.histogram(A.table(spark, d, "events"), "value", (1, 5, 10, 50, 100, 500))


@query("""SELECT project_id, project, group_name, coalesce(last_scan, -1) AS last_scan, coalesce(c, 0) AS completed_scans, coalesce(n, 0) AS findings FROM projects LEFT JOIN groups USING (group_id)
LEFT JOIN (SELECT project_id, count(*) AS c, arg_max(scan_id, (completed_at, scan_id)) AS last_scan FROM scans WHERE scan_status = 'completed' GROUP BY 1) USING (project_id)
LEFT JOIN (SELECT project_id, count(*) AS n FROM findings WHERE scan_id IN (SELECT scan_id FROM scans WHERE scan_status = 'completed') GROUP BY 1) USING (project_id)""")
def portfolio_project_overview(spark, d):
    return portfolio.project_overview(A.projects(spark, d), A.groups(spark, d), A.scans(spark, d), A.findings(spark, d)).na.fill(-1, ["last_scan"])


@query("SELECT group_id, group_name, coalesce(n, 0) AS projects FROM groups LEFT JOIN (SELECT group_id, count(*) AS n FROM projects GROUP BY 1) USING (group_id)")
def portfolio_group_counts(spark, d):
    return portfolio.group_counts(A.groups(spark, d), A.projects(spark, d))


@query("SELECT project_id, count(*) AS n, string_agg(DISTINCT tls_version, ',' ORDER BY tls_version) AS versions, string_agg(DISTINCT service_name, ',' ORDER BY service_name) AS services FROM observations GROUP BY 1")
def portfolio_runtime_summary(spark, d):
    return portfolio.runtime_summary(A.observations(spark, d))


@query("SELECT project_id, service_name, tls_version, event_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, service_name ORDER BY observed_at DESC, event_id DESC) AS k FROM observations) WHERE k = 1")
def links_latest_service(spark, d):
    return portfolio.latest_service_state(A.observations(spark, d))


@query(f"SELECT *, fp_pct > 50 OR fix_pct < 10 AS warning FROM (SELECT *, {_PCT('false_positives', 'total', 2)} AS fp_pct, {_PCT('fixed', 'total', 2)} AS fix_pct FROM (SELECT rule_id, count(*) AS total, count(*) FILTER (status = 'false_positive') AS false_positives, count(*) FILTER (status = 'resolved') AS fixed FROM findings GROUP BY 1))")
def portfolio_rule_analytics(spark, d):
    return portfolio.rule_analytics(A.findings(spark, d))


@query("SELECT strftime(observed_at, '%Y-%m-%d') AS day, service_name, count(*) AS n, count(*) FILTER (tls_version IN ('1.2', '1.3')) AS compliant FROM observations GROUP BY 1, 2")
def portfolio_daily(spark, d):
    return portfolio.daily_counts(A.observations(spark, d))


# --- drift --------------------------------------------------------------------------------------------------


def _halves(spark, d):
    """Two inventories of distinct (project, file, line, name) rows, by the parity of the part."""
    f = A.findings(spark, d)
    by = lambda rows: rows.groupBy("project_id", "file", "name").agg(F.min("severity").alias("severity"), F.max("line").alias("line"))
    return by(f.where("seq % 2 = 0")), by(f.where("seq % 2 = 1"))


_HALVES = "b AS (SELECT project_id, file, name, min(severity) AS severity, max(line) AS line FROM findings WHERE seq % 2 = 0 GROUP BY ALL), a AS (SELECT project_id, file, name, min(severity) AS severity, max(line) AS line FROM findings WHERE seq % 2 = 1 GROUP BY ALL) "


@query(WITH.rstrip() + ", " + _HALVES + """SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.file, b.file) AS file, coalesce(a.name, b.name) AS name,
CASE WHEN b.file IS NULL THEN 'added' WHEN a.file IS NULL THEN 'removed' WHEN a.severity <> b.severity OR a.line <> b.line THEN 'changed' ELSE 'unchanged' END AS change,
CASE WHEN a.file IS NULL OR b.file IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.severity <> b.severity THEN 'severity' END, CASE WHEN a.line <> b.line THEN 'line' END) END AS changes FROM a FULL JOIN b ON a.project_id = b.project_id AND a.file = b.file AND a.name = b.name""", plain=True)
def drift_diff(spark, d):
    before, after = _halves(spark, d)
    return drift.diff(before, after, ["project_id", "file", "name"], ["severity", "line"])


@query("SELECT project_id, file, line, name, finding_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id, file, line, name ORDER BY scan_id DESC, finding_id DESC) AS k FROM findings) WHERE k = 1")
def drift_merge(spark, d):
    return drift.merge(A.findings(spark, d), ["project_id", "file", "line", "name"], "scan_id", "finding_id").select("project_id", "file", "line", "name", "finding_id")


@query(WITH.rstrip() + """, e AS (SELECT project_id, sha256(rule_id || ':' || file) AS fingerprint, min(status) AS status, 0 AS reopen_count FROM findings WHERE seq % 2 = 0 GROUP BY 1, 2), n AS (SELECT DISTINCT project_id, sha256(rule_id || ':' || file) AS fingerprint FROM findings WHERE seq % 2 = 1)
SELECT *, CASE WHEN action IN ('new', 'reopened') THEN 'open' WHEN action = 'resolved' THEN 'resolved' ELSE status END AS next_status, CASE WHEN action = 'reopened' THEN 1 ELSE 0 END AS reopen_count FROM (SELECT coalesce(e.project_id, n.project_id) AS project_id, coalesce(e.fingerprint, n.fingerprint) AS fingerprint,
CASE WHEN e.fingerprint IS NULL THEN 'new' WHEN n.fingerprint IS NOT NULL AND status = 'resolved' THEN 'reopened' WHEN n.fingerprint IS NOT NULL THEN 'matched' WHEN status IN ('open', 'in_review', 'in_progress') THEN 'resolved' ELSE 'kept' END AS action, status FROM e FULL JOIN n ON e.project_id = n.project_id AND e.fingerprint = n.fingerprint)""".replace("SELECT *, CASE WHEN action", "SELECT project_id, fingerprint, action, CASE WHEN action"), plain=True)
def drift_match(spark, d):
    f = A.findings(spark, d).withColumn("fingerprint", F.sha2(F.concat_ws(":", "rule_id", "file"), 256))
    existing = f.where("seq % 2 = 0").groupBy("project_id", "fingerprint").agg(F.min("status").alias("status")).withColumn("reopen_count", F.lit(0))
    return drift.match_findings(existing, f.where("seq % 2 = 1"))


_BASE = ", g AS (SELECT *, rule_id || ':' || file AS fingerprint, CASE asset_type WHEN 'algorithm' THEN 'inventory' ELSE 'security' END AS category FROM findings), base AS (SELECT DISTINCT fingerprint FROM g WHERE part % 3 = 0) "


def _baselined(spark, d):
    f = A.findings(spark, d).withColumns({"fingerprint": F.concat_ws(":", "rule_id", "file"), "category": F.when(F.col("asset_type") == "algorithm", "inventory").otherwise("security")})
    entries = f.where("part % 3 = 0").select("fingerprint").distinct()
    return drift.apply_baseline(f, A.dealt(entries, "fingerprint", A.rows_of_findings(spark, d)))  # findings come to them in as many parts


@query(WITH.rstrip() + _BASE + "SELECT finding_id, fingerprint, category FROM g WHERE category = 'inventory' OR fingerprint NOT IN (SELECT fingerprint FROM base)", plain=True)
def drift_baseline_kept(spark, d):
    return _baselined(spark, d)[0].select("finding_id", "fingerprint", "category")


@query(WITH.rstrip() + _BASE + "SELECT fingerprint FROM base WHERE fingerprint NOT IN (SELECT fingerprint FROM g WHERE category <> 'inventory')", plain=True)
def drift_baseline_stale(spark, d):
    return _baselined(spark, d)[1]


@query()
def drift_dedupe_passes(spark, d):
    confidence = F.when(F.col("part") % 3 == 0, "high").when(F.col("part") % 3 == 1, "medium").otherwise("low")
    f = A.findings(spark, d).withColumns({"confidence": confidence, "description": F.concat(F.lit("found "), "name")})
    return drift.dedupe_passes(f.where("seq % 2 = 0"), f.where("seq % 2 = 1"))


@query("SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY completed_at, scan_id) AS INTEGER) AS version FROM scans")
def drift_versions(spark, d):
    return drift.versions(A.scans(spark, d))


@query("SELECT project_id, file, source, target FROM (SELECT project_id, file, finding_id AS source, lead(finding_id) OVER (PARTITION BY project_id, file ORDER BY line, finding_id) AS target FROM findings) WHERE target IS NOT NULL")
def links_colocation(spark, d):
    return drift.colocation(A.findings(spark, d))


@query(WITH.rstrip() + ", " + _HALVES + "SELECT project_id, file, name FROM a EXCEPT SELECT project_id, file, name FROM b", plain=True)
def drift_except(spark, d):
    before, after = (x.select("project_id", "file", "name") for x in _halves(spark, d))
    return after.subtract(before)


@query(WITH.rstrip() + ", " + _HALVES + "SELECT project_id, file, name FROM a INTERSECT SELECT project_id, file, name FROM b", plain=True)
def drift_intersect(spark, d):
    before, after = (x.select("project_id", "file", "name") for x in _halves(spark, d))
    return after.intersect(before)


# --- policy and filters -------------------------------------------------------------------------------------

_RULES = """, v AS (SELECT r.rule, r.rank, fp.* FROM fp JOIN (VALUES ('no-broken', 5), ('no-legacy-hash', 4), ('rsa-size', 3), ('urgent', 4), ('no-md4', 2)) r(rule, rank) ON (rule = 'no-broken' AND posture = 'broken') OR (rule = 'no-legacy-hash' AND family IN ('md5', 'sha1')) OR (rule = 'rsa-size' AND family = 'rsa' AND key_size < 3072) OR (rule = 'urgent' AND severity = 'critical') OR (rule = 'no-md4' AND family = 'md4')) """


@query(WITH.rstrip() + _RULES + "SELECT rule, action, coalesce(n, 0) AS violations, coalesce(p, 0) AS projects, n IS NULL AS passed FROM (VALUES ('no-broken', 'fail'), ('no-legacy-hash', 'fail'), ('rsa-size', 'warn'), ('urgent', 'warn'), ('no-md4', 'fail')) r(rule, action) LEFT JOIN (SELECT rule, count(*) AS n, count(DISTINCT project_id) AS p FROM v GROUP BY 1) USING (rule)", plain=True)
def policy_evaluate(spark, d):
    return policy.evaluate(A.findings(spark, d), policy.rules(spark))


@query(WITH.rstrip() + _RULES + "SELECT project_id, count(*) FILTER (rank >= 4) AS failures, count(*) FILTER (rank < 4) AS warnings, count(DISTINCT rule) AS rules FROM v GROUP BY 1", plain=True)
def policy_gate(spark, d):
    return policy.gate(A.findings(spark, d), policy.rules(spark))


@query("""SELECT project_id, CASE WHEN o.a IS NOT NULL AND NOT coalesce(o.l, FALSE) THEN CASE WHEN g.a IS NOT NULL THEN 'group' ELSE 'org' END WHEN o.a IS NOT NULL THEN 'org' WHEN g.a IS NOT NULL THEN 'group' ELSE 'default' END AS source,
CASE WHEN o.a IS NOT NULL AND coalesce(o.l, FALSE) THEN o.a WHEN g.a IS NOT NULL THEN g.a WHEN o.a IS NOT NULL THEN o.a ELSE 'fail' END AS action, coalesce(o.l, FALSE) OR coalesce(g.l, FALSE) AS locked FROM projects JOIN groups USING (group_id)
LEFT JOIN (SELECT org_id AS k, 'warn' AS a, org_id = 1 AS l FROM (SELECT DISTINCT org_id FROM groups) WHERE org_id < 3) o ON org_id = o.k LEFT JOIN (SELECT group_id AS k, 'ignore' AS a, FALSE AS l FROM groups WHERE group_id % 2 = 0) g ON group_id = g.k""")
def policy_cascade(spark, d):
    rows = A.projects(spark, d).join(A.groups(spark, d), "group_id")
    org = rows.where("org_id < 3").select("project_id", F.lit("warn").alias("action"), (F.col("org_id") == 1).alias("locked"))
    group = rows.where("group_id % 2 = 0").select("project_id", F.lit("ignore").alias("action"), F.lit(False).alias("locked"))
    return policy.cascade(rows, [("org", org), ("group", group)], "project_id")


@query("SELECT reason, count(*) AS n FROM (SELECT CASE WHEN supp % 7 = 0 THEN 'default-off' WHEN asset_type = 'algorithm' THEN 'category' WHEN rule_id IN ('r-3', 'r-5') THEN 'disabled' ELSE 'kept' END AS reason FROM findings) GROUP BY 1")
def filter_lifecycle_stats(spark, d):
    reason = policy.drop_reason(F.when(F.col("asset_type") == "algorithm", "inventory"), F.col("supp") % 7 != 0, F.lit("stable"), disabled=("r-3", "r-5"))
    return A.findings(spark, d).groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT finding_id, name, file, rule_id FROM findings WHERE (contains(lower(name), 'aes') OR contains(lower(file), 'aes') OR contains(lower(rule_id), 'aes')) AND severity = 'high'")
def filter_search(spark, d):
    return policy.search(A.findings(spark, d), "AES", "high").select("finding_id", "name", "file", "rule_id")


@query("SELECT reason, count(*) AS n, coalesce(string_agg(DISTINCT CASE WHEN seq % 2 = 0 THEN rule_id END, ',' ORDER BY CASE WHEN seq % 2 = 0 THEN rule_id END), '') AS deprecated_rules FROM (SELECT *, CASE part % 3 WHEN 0 THEN 'category' WHEN 1 THEN 'disabled' ELSE 'kept' END AS reason FROM findings) GROUP BY 1")
def filter_lifecycle_deprecated(spark, d):
    f = A.findings(spark, d).withColumns({"drop_reason": F.when(F.col("part") % 3 == 0, "category").when(F.col("part") % 3 == 1, "disabled"), "maturity": F.when(F.col("seq") % 2 == 0, "deprecated").otherwise("stable")})
    return policy.lifecycle_stats(f)


@query("SELECT severity, count(*) AS n FROM findings WHERE severity IN ('critical', 'high') GROUP BY 1")
def filter_fail_on(spark, d):
    return policy.fail_on(A.findings(spark, d), "high")


@query(f"SELECT project_id, coalesce(CAST(floor((epoch(TIMESTAMP '{NOW}') - epoch(l)) / 86400) AS BIGINT), -1) AS days FROM projects LEFT JOIN (SELECT project_id, max(completed_at) AS l FROM scans WHERE scan_status = 'completed' GROUP BY 1) USING (project_id) WHERE l IS NULL OR floor((epoch(TIMESTAMP '{NOW}') - epoch(l)) / 86400) > 400")
def filter_stale_projects(spark, d):
    return policy.stale_projects(A.projects(spark, d), A.scans(spark, d), NOW, 400).na.fill(-1, ["days"])


@query("SELECT finding_id, asset_type FROM findings WHERE asset_type IN ('certificate', 'protocol')")
def filter_asset_types(spark, d):
    return policy.filter_asset_types(A.findings(spark, d), ("Certificate ", "protocol", "algorithm"), ("algorithm",)).select("finding_id", "asset_type")


@query("SELECT project_id, count(*) AS n FROM findings WHERE project_id IN (SELECT project_id FROM projects JOIN groups USING (group_id) WHERE org_id = 2) GROUP BY 1")
def filter_tenant_scope(spark, d):
    scope = A.projects(spark, d).join(A.groups(spark, d).where("org_id = 2"), "group_id").select("project_id")
    return A.findings(spark, d).join(scope, "project_id", "left_semi").groupBy("project_id").agg(F.count("*").alias("n"))


@query("WITH RECURSIVE " + A.SQL.strip() + ", t AS (SELECT group_id, 0 AS depth FROM groups WHERE group_id = 1 UNION ALL SELECT g.group_id, t.depth + 1 FROM groups g JOIN t ON g.parent_group_id = t.group_id) SELECT group_id, depth FROM t", plain=True)
def links_group_subtree(spark, d):
    return policy.group_subtree(spark, A.groups(spark, d), 1)


@query("""SELECT event_id, old_status, new_status, CASE WHEN (old_status, new_status) NOT IN (('open', 'in_review'), ('open', 'resolved'), ('open', 'false_positive'), ('in_review', 'resolved'), ('in_review', 'open'), ('resolved', 'open'), ('false_positive', 'open')) THEN 'illegal' WHEN new_status = 'false_positive' AND reason IS NULL THEN 'reason required' END AS error
FROM (SELECT event_id, ['open', 'in_review', 'resolved', 'false_positive'][CAST(event_id % 4 + 1 AS INTEGER)] AS old_status, ['open', 'in_review', 'resolved', 'false_positive'][CAST(user_id % 4 + 1 AS INTEGER)] AS new_status, CASE WHEN event_id % 8 < 4 THEN 'seen' END AS reason FROM events)""", plain=True)
def links_transitions(spark, d):
    states = ("open", "in_review", "resolved", "false_positive")
    rows = A.table(spark, d, "events").select("event_id", A._pick(states, F.col("event_id") % 4).alias("old_status"), A._pick(states, F.col("user_id") % 4).alias("new_status"), F.when(F.col("event_id") % 8 < 4, "seen").alias("reason"))
    return policy.validate_transitions(spark, rows).select("event_id", "old_status", "new_status", "error")


@query("SELECT project_id, env, scan_id FROM (SELECT project_id, scan_status AS env, scan_id, row_number() OVER (PARTITION BY project_id, scan_status ORDER BY completed_at DESC, scan_id DESC) AS k FROM scans) WHERE k = 1")
def links_promoted(spark, d):
    return drift.last_by(A.scans(spark, d).withColumnRenamed("scan_status", "env"), ["project_id", "env"], [F.desc("completed_at"), F.desc("scan_id")]).select("project_id", "env", "scan_id")


@query(f"SELECT *, {_PCT('tp', '(tp + fn)')} AS recall, {_PCT('tp', '(tp + fp)')} AS precision FROM (SELECT bucket, count(*) FILTER (e AND t) AS tp, count(*) FILTER (e AND NOT t) AS fp, count(*) FILTER (t AND NOT e) AS fn FROM (SELECT d.lang AS bucket, d.doc_id, coalesce(d.n_chars > 500, FALSE) AS e, l.doc_id IS NOT NULL AS t FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id) GROUP BY bucket) WHERE tp + fp + fn > 0", plain=True)
def links_scoreboard(spark, d):
    docs = A.table(spark, d, "documents").select(F.col("lang").alias("bucket"), "doc_id", "n_chars")
    truth = docs.join(A.table(spark, d, "labels").where("quality = 1").select("doc_id").distinct(), "doc_id")
    return policy.scoreboard(docs.where("n_chars > 500"), truth, "bucket", "doc_id")


# --- normalisation ------------------------------------------------------------------------------------------


@query(f"SELECT finding_id, family, {_LITE} AS family_lite, posture, CASE WHEN family IN ('md5', 'sha1', 'des', '3des', 'rc4') THEN 'critical' WHEN family IN ('rsa', 'ecdsa', 'ecdh', 'dsa', 'dh') THEN 'medium' ELSE 'info' END AS inferred FROM fp")
def norm_families(spark, d):
    f = portfolio.with_posture(A.findings(spark, d))
    return f.select("finding_id", "family", X.algorithm_family(F.col("name"), table=X.FAMILY_LITE).alias("family_lite"), "posture", X.posture_severity(N.infer_posture(F.col("family"))).alias("inferred"))


@query("""SELECT finding_id, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level, CASE severity WHEN 'critical' THEN 60 WHEN 'high' THEN 30 WHEN 'medium' THEN 15 ELSE 5 END AS effort,
CASE WHEN key_size IS NULL THEN 'unknown' WHEN key_size < 2048 THEN 'weak' WHEN key_size < 3072 THEN 'legacy' ELSE 'strong' END AS band, CASE WHEN posture = 'broken' THEN 'critical' WHEN posture = 'vulnerable' AND asset_type = 'protocol' THEN 'critical' WHEN posture = 'vulnerable' AND asset_type = 'certificate' THEN 'high' WHEN posture = 'vulnerable' THEN 'medium' WHEN posture = 'safe' THEN 'none' END AS priority FROM fp""")
def norm_levels(spark, d):
    f = portfolio.with_posture(A.findings(spark, d))
    primitive = F.when(F.col("asset_type") == "protocol", "kem").when(F.col("asset_type") == "certificate", "signature")
    return f.select("finding_id", X.sarif_level(F.col("severity")).alias("level"), X.effort_minutes(F.col("severity")).alias("effort"), X.key_size_band(F.col("key_size")).alias("band"), X.quantum_priority(F.col("posture"), primitive).alias("priority"))


@query("SELECT event_id, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS ago FROM (SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-02-15 00:00:00') - floor(epoch(ts))) AS BIGINT) AS s FROM events)", plain=True)
def norm_relative_time(spark, d):
    seconds = F.unix_timestamp(F.lit("2024-02-15 00:00:00").cast("timestamp")) - F.unix_timestamp("ts")
    return A.table(spark, d, "events").select("event_id", X.relative_time(seconds).alias("ago"))


# --- detection ----------------------------------------------------------------------------------------------


def corpus(spark, d):
    return A.table(spark, d, "documents").select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").alias("content"))


_LINES = "WITH c AS (SELECT source || '/' || doc_id || '.txt' AS path, string_split(text, chr(10)) AS l FROM documents), lines AS (SELECT path, i AS line, l[i] AS text FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM c)) "


@query(_LINES + "SELECT path, count(*) AS lines, max(length(text)) AS longest FROM lines GROUP BY 1", plain=True)
def detect_lines(spark, d):
    return detect.explode_lines(corpus(spark, d)).groupBy("path").agg(F.count("*").alias("lines"), F.max(F.length("text")).cast("long").alias("longest"))


@query(_LINES + "SELECT path, line, lower(regexp_extract(text, p, 1)) AS key, regexp_extract(text, p, 2) AS value FROM lines, (SELECT '((?i:secret|token|password|passwd|api_?key|private_?key)[A-Za-z0-9_]*)\\s*[=:]\\s*[\"'']?([^\"''\\s]+)' AS p) WHERE regexp_matches(text, p) AND length(regexp_extract(text, p, 2)) >= 4 AND NOT regexp_matches(regexp_extract(text, p, 2), '^\\d+$')", plain=True)
def detect_assignments(spark, d):
    out = detect.scan_assignments(detect.explode_lines(corpus(spark, d)))
    return out.select("path", F.col("line").cast("long").alias("line"), "key", "value")


_BANNERS = ("OpenSSL 3.0.", "LibreSSL 3.9.", "BoringSSL ", "mbedTLS 2.28.", "NSS 3.", "OpenSSL ")


def _banner_sql() -> str:
    parts = []
    for library, (package, banner) in detect.LIBRARY_BANNERS.items():
        version = f"regexp_extract(content, '{banner}', 1)" if "(" in banner else "''"
        parts.append(f"SELECT path, '{library}' AS library, {version} AS version, CASE WHEN {version} = '' THEN '' ELSE 'pkg:generic/{package}@' || {version} END AS purl, 'cbom-binary-lib-{package}' AS rule_id FROM b WHERE regexp_matches(content, '{banner}')")
    return f"WITH b AS (SELECT 'bin/' || p_partkey AS path, p_name || {A._CASE(f'p_partkey % {len(_BANNERS)}', _BANNERS)} || p_size || ' and libsodium 1.0.' || p_size AS content FROM part) " + " UNION ALL ".join(parts)


@query(_banner_sql(), plain=True)
def detect_library_banners(spark, d):
    content = F.concat("p_name", A._pick(_BANNERS, F.col("p_partkey") % len(_BANNERS)), F.col("p_size").cast("string"), F.lit(" and libsodium 1.0."), F.col("p_size").cast("string"))
    return detect.library_banners(A.table(spark, d, "part").select(F.concat(F.lit("bin/"), F.col("p_partkey").cast("string")).alias("path"), content.cast("binary").alias("content")))


_RECIPES = ("RUN apt-get update && apt-get install -y openssl", "  run apk add openssl=3.0.2 libssl-dev", "# RUN yum install openssl", "RUN dnf install libssl1.1 openssl-libs", "RUN make install")
_NAMES = ("Dockerfile", "dockerfile.dev", "web.Dockerfile", "notes.txt")


@query(f"""WITH l AS (SELECT p_partkey || '/' || {A._CASE(f'p_size % {len(_NAMES)}', _NAMES)} AS path, unnest(['FROM ' || p_name, {A._CASE(f'p_partkey % {len(_RECIPES)}', _RECIPES)}, 'EXPOSE 443/tcp ' || p_size || ' 8443']) AS raw, unnest([1, 2, 3]) AS line FROM part),
t AS (SELECT path, line, trim(raw) AS text FROM l WHERE NOT path LIKE '%.txt'), i AS (SELECT * FROM t WHERE upper(text) LIKE 'RUN%' AND regexp_matches(text, '(?i)\\b{detect.INSTALL}\\b'))
SELECT path, line, 'cbom-configfile-dockerfile-unpinned-openssl' AS rule_id, 'Unpinned OpenSSL install' AS name FROM i WHERE regexp_matches(text, '(?i)\\bopenssl\\b') AND NOT regexp_matches(text, '(?i)\\b{detect.PINNED}')
UNION ALL SELECT path, line, 'cbom-configfile-dockerfile-unpinned-crypto-lib', 'Unpinned crypto library install' FROM i WHERE regexp_matches(text, '(?i)\\b{detect.CRYPTO_PACKAGES}\\b')
UNION ALL SELECT path, line, 'cbom-configfile-dockerfile-tls-port', 'TLS endpoint: EXPOSE ' || p FROM (SELECT path, line, unnest(['443', '8443']) AS p FROM t WHERE text LIKE 'EXPOSE%')""", plain=True)
def detect_dockerfiles(spark, d):
    part = A.table(spark, d, "part")
    path = F.concat_ws("/", F.col("p_partkey").cast("string"), A._pick(_NAMES, F.col("p_size") % len(_NAMES)))
    content = F.concat_ws("\n", F.concat(F.lit("FROM "), "p_name"), A._pick(_RECIPES, F.col("p_partkey") % len(_RECIPES)), F.concat(F.lit("EXPOSE 443/tcp "), F.col("p_size").cast("string"), F.lit(" 8443")))
    return detect.dockerfile_findings(part.select(path.alias("path"), content.alias("content")))


_DISABLED, _STORES, _MANAGERS = ("SSLv3, RC4, |  MD5", "3DES, TLSv1.1, md5", ""), ("pkcs12", "JKS", "own"), ("PKIX", "sunx509", "other", "X509")


def _java_sql() -> str:
    value = f"replace({A._CASE(f'p_partkey % {len(_DISABLED)}', _DISABLED)}, '|', chr(92) || chr(10))"
    content = f"concat_ws(chr(10), '# ' || p_name || ' = x', 'jdk.tls.disabledAlgorithms=' || {value}, 'jdk.certpath.disabledAlgorithms = ' || {value}, 'keystore.type = ' || {A._CASE(f'p_size % {len(_STORES)}', _STORES)}, 'ssl.KeyManagerFactory.algorithm=' || {A._CASE(f'p_size % {len(_MANAGERS)}', _MANAGERS)})"
    weak = ", ".join(f"('{k}', '{v}', {t})" for t, table in (("FALSE", detect.JAVA_WEAK), ("TRUE", detect.JAVA_WEAK_TLS)) for k, v in table.items())
    known = [("keymanager-algorithm", "ssl.KeyManagerFactory.algorithm", detect.KEY_MANAGERS), ("keystore-type", "keystore.type", detect.KEY_STORES)]
    return f"""WITH c AS (SELECT p_partkey || '/java.security' AS path, string_split(replace({content}, chr(92) || chr(10), ''), chr(10)) AS l FROM part),
k AS (SELECT path, line, trim(split_part(text, '=', 1)) AS key, lower(trim(split_part(text, '=', 2))) AS value FROM (SELECT path, CAST(i AS INTEGER) AS line, l[i] AS text FROM (SELECT path, l, unnest(range(1, len(l) + 1)) AS i FROM c)) WHERE text LIKE '%=%' AND NOT text LIKE '#%')
SELECT path, line, 'cbom-configfile-java-missing-disabled-algo' AS rule_id, 'Missing disabled algorithm: ' || name AS name, severity FROM k, (VALUES {weak}) w(name, severity, tls) WHERE (key = 'jdk.tls.disabledAlgorithms' OR key = 'jdk.certpath.disabledAlgorithms' AND NOT tls) AND NOT contains(value, lower(name))""" + "".join(f" UNION ALL SELECT path, line, 'cbom-configfile-java-{rule}', {_MAP('value', table, 'NULL')}, 'info' FROM k WHERE key = '{key}' AND value IN {_IN(table)}" for rule, key, table in known)


@query(_java_sql(), plain=True)
def detect_java_security(spark, d):
    part = A.table(spark, d, "part")
    value = F.replace(A._pick(_DISABLED, F.col("p_partkey") % len(_DISABLED)), F.lit("|"), F.lit("\\\n"))
    lines = [F.concat(F.lit("# "), "p_name", F.lit(" = x")), F.concat(F.lit("jdk.tls.disabledAlgorithms="), value), F.concat(F.lit("jdk.certpath.disabledAlgorithms = "), value),
             F.concat(F.lit("keystore.type = "), A._pick(_STORES, F.col("p_size") % len(_STORES))), F.concat(F.lit("ssl.KeyManagerFactory.algorithm="), A._pick(_MANAGERS, F.col("p_size") % len(_MANAGERS)))]
    return detect.java_security_findings(part.select(F.concat(F.col("p_partkey").cast("string"), F.lit("/java.security")).alias("path"), F.concat_ws("\n", *lines).alias("content")))


@query(r"""SELECT doc_id, sha256('r-1:' || coalesce(source, '') || ':' || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '(?s)/\*.*?\*/', '', 'g'), '(?://|#)[^\n]*', '', 'g'), '"[^"]*"|''[^'']*''', 'STR', 'g'), '\b[0-9]+\b', 'NUM', 'g'), '\s+', ' ', 'g'))) AS fingerprint FROM documents""", plain=True)
def fingerprint_documents(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("source", "text")))
    return docs.select("doc_id", detect.fingerprint(F.lit("r-1"), F.col("source"), F.col("text")).alias("fingerprint"))


QUERIES["fingerprint_all_documents"], ORACLE["fingerprint_all_documents"] = fingerprint_documents, ORACLE["fingerprint_documents"]


@query("SELECT scan_id, finding_id, rule_id, CAST(dense_rank() OVER (PARTITION BY scan_id ORDER BY s, i) - 1 AS INTEGER) AS rule_index, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'note' END AS level FROM (SELECT *, min(seq) OVER w AS s, first_value(finding_id) OVER (PARTITION BY scan_id, rule_id ORDER BY seq, finding_id) AS i FROM findings WINDOW w AS (PARTITION BY scan_id, rule_id))")
def portfolio_sarif(spark, d):
    return D.sarif_results(A.findings(spark, d))


@query()
def portfolio_cbom_documents(spark, d):
    return D.cbom_documents(A.findings(spark, d))


@query("SELECT project_id, count(*) AS n, CAST(dense_rank() OVER (ORDER BY count(*) DESC) AS INTEGER) AS place FROM findings GROUP BY 1 QUALIFY place <= 5")
def portfolio_ranked(spark, d):
    by = A.findings(spark, d).groupBy("project_id").agg(F.count("*").alias("n"))
    top = by.select("n").distinct().orderBy(F.desc("n")).limit(5)  # five rows; only these are ranked
    return by.join(top.withColumn("place", F.row_number().over(W.orderBy(F.desc("n")))), "n").select("project_id", "n", "place")


def _class_sql(framework: str) -> str:
    f = frameworks.FRAMEWORKS[framework]
    whens = " ".join(f"WHEN '{name}' THEN CASE WHEN key_size < {least} THEN '{f['small']}' ELSE '{kind}' END" for kind, families in f["classes"].items() for name, least in families.items())
    return f"CASE family {whens} ELSE '{f['other']}' END"


def _items_sql(framework: str, more: str = "") -> str:
    good = frameworks.FRAMEWORKS[framework]["good"]
    return _more(f"SELECT project_id, family, n, classification, CASE classification WHEN '{good}' THEN 'none' WHEN 'deprecated' THEN 'schedule-migration' ELSE 'immediate-remediation' END AS action{more} FROM (SELECT project_id, family, n, {_class_sql(framework)} AS classification FROM nist)")


@query(_items_sql("fips-140-3"), plain=True)
def compliance_fips(spark, d):
    return frameworks.items(A.findings(spark, d), "fips-140-3")


@query(_items_sql("pci-dss-v4", f", {_MAP('family', frameworks.PCI_REQUIREMENT, chr(39) * 2)} AS requirement"), plain=True)
def compliance_pci(spark, d):
    return frameworks.items(A.findings(spark, d), "pci-dss-v4")


@query(_items_sql("cnsa-2", f", {_MAP('classification', frameworks.CNSA_DEADLINE, chr(39) * 2)} AS deadline"), plain=True)
def compliance_cnsa(spark, d):
    return frameworks.items(A.findings(spark, d), "cnsa-2")


@query(_more("SELECT *, round_even(compliant * 100.0 / findings, 1) AS score FROM (" + " UNION ALL ".join(f"SELECT project_id, CAST(sum(n) AS BIGINT) AS findings, '{k}' AS framework, CAST(sum(CASE WHEN {_class_sql(k)} = '{f['good']}' THEN n ELSE 0 END) AS BIGINT) AS compliant FROM nist GROUP BY 1" for k, f in frameworks.FRAMEWORKS.items()) + ")"), plain=True)
def compliance_framework_scores(spark, d):
    return frameworks.scores(A.findings(spark, d))


def _iso_sql() -> str:
    parts = []
    for check, rule in frameworks.ISO_CHECKS.items():
        if isinstance(rule, dict):
            said = ", ".join(f"max(CASE WHEN family = '{k}' AND key_size < {v} THEN '{k}: ' || key_size || ' < {v}' END)" for k, v in rule.items())
        else:
            said = ", ".join(f"max(CASE WHEN family = '{k}' THEN '{k}' END)" for k in rule)
        evidence = f"concat_ws('{'; ' if isinstance(rule, dict) else ', '}', {said})"
        parts.append(f"SELECT project_id, '{check}' AS check_id, CASE WHEN {evidence} = '' THEN 'pass' ELSE 'fail' END AS status, CAST(coalesce(sum(n) FILTER (family IN {_IN(rule)}), 0) AS BIGINT) AS findings_count, {evidence} AS evidence FROM nist GROUP BY project_id")
    parts += [f"SELECT DISTINCT project_id, '{check}', 'manual-review', CAST(0 AS BIGINT), '' FROM nist" for check in frameworks.ISO_MANUAL]
    return " UNION ALL ".join(parts)


@query(_more(_iso_sql()), plain=True)
def compliance_iso_checklist(spark, d):
    return frameworks.iso_checklist(A.findings(spark, d))


def _cra_sql() -> str:
    parts = []
    for requirement, (absent, sizes, advice) in frameworks.CRA_CHECKS.items():
        rules = {**{k: f"family = '{k}'" for k in absent}, **{k: f"family = '{k}' AND key_size < {v}" for k, v in sizes.items()}}
        said = ", ".join(f"max(CASE WHEN {rule} THEN '{k}' END)" for k, rule in rules.items()) or "''"
        bad = " OR ".join(f"({rule})" for rule in rules.values()) or "FALSE"
        parts.append(f"SELECT project_id, '{requirement}' AS requirement_id, concat_ws(', ', {said}) AS affected, CAST(coalesce(sum(n) FILTER ({bad}), 0) AS BIGINT) AS affected_count, '{advice}' AS advice FROM nist GROUP BY project_id")
    manual = " UNION ALL ".join(f"SELECT DISTINCT project_id, '{r}' AS requirement_id, 'manual-review' AS gap_status, '' AS affected, CAST(0 AS BIGINT) AS affected_count, 'Manual review required' AS recommendation FROM nist" for r in frameworks.CRA_MANUAL)
    return f"SELECT project_id, requirement_id, CASE WHEN affected = '' THEN 'no-gap' ELSE 'gap' END AS gap_status, affected, affected_count, CASE WHEN affected = '' THEN '' ELSE replace(advice, '{{}}', affected) END AS recommendation FROM ({' UNION ALL '.join(parts)}) UNION ALL {manual}"


@query(_more(_cra_sql()), plain=True)
def compliance_cra_gaps(spark, d):
    return frameworks.cra_gaps(A.findings(spark, d))


_LIBRARIES = ("aes", "RSA", "Brand#13", "openssl", "sha-2", "chacha20", "kyber")


@query(WITH.rstrip() + f""", b AS (SELECT o_custkey AS project_id, o_orderkey AS sbom_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders),
c AS (SELECT project_id, unnest([{A._CASE(f'sbom_id % {len(_LIBRARIES)}', _LIBRARIES)}, {A._CASE(f'(sbom_id + 2) % {len(_LIBRARIES)}', _LIBRARIES)}]) AS library FROM b WHERE k = 1)
SELECT c.project_id, library, count(f.project_id) AS findings_count, coalesce(string_agg(DISTINCT name, ',' ORDER BY name), '') AS crypto_findings FROM c LEFT JOIN findings f ON c.project_id = f.project_id AND (contains(lower(name), lower(library)) OR contains(lower(file), lower(library))) GROUP BY 1, 2""", plain=True)
def links_sbom(spark, d):
    names = F.array(*(A._pick(_LIBRARIES, (F.col("o_orderkey") + k) % len(_LIBRARIES)) for k in (0, 2)))
    parts = A.table(spark, d, "orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("sbom_id"), F.col("o_orderdate").alias("created_at"), F.explode(names).alias("name"))
    return links.sbom_links(parts, A.findings(spark, d))


_ROLES = tuple(links.ROLE_RANK)
_RANK = lambda c: f"CASE {c} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in links.ROLE_RANK.items()) + " ELSE 0 END"


@query(f"""SELECT user_id, coalesce(group_id, -1) AS group_id, CASE WHEN g IS NULL OR {_RANK('r')} >= {_RANK('g')} THEN r ELSE g END AS role FROM (SELECT c_custkey AS user_id, {A._CASE('c_custkey % 7', _ROLES)} AS r FROM customer)
LEFT JOIN (SELECT s_suppkey AS user_id, CAST(s_nationkey AS INTEGER) AS group_id, {A._CASE('(s_suppkey // 3) % 8', (*_ROLES, 'visitor'))} AS g FROM supplier) USING (user_id)""", plain=True)
def portfolio_effective_roles(spark, d):
    users = A.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), A._pick(_ROLES, F.col("c_custkey") % 7).alias("role"))
    members = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").cast("int").alias("group_id"), A._pick((*_ROLES, "visitor"), F.floor(F.col("s_suppkey") / 3) % 8).alias("group_role"))
    return links.effective_roles(users, members).na.fill(-1, ["group_id"])


@query("""SELECT project_id, CASE WHEN project_id % 3 = 0 THEN 'p' || project_id WHEN g.group_id % 2 = 0 THEN 'g' || g.group_id WHEN org_id % 2 = 1 THEN 'o' || org_id END AS cron,
CASE WHEN project_id % 3 = 0 THEN 'project' WHEN g.group_id % 2 = 0 THEN 'group' WHEN org_id % 2 = 1 THEN 'org' ELSE 'none' END AS source FROM projects p LEFT JOIN groups g ON p.group_id = g.group_id""")
def policy_schedules(spark, d):
    cron = lambda c, kind, when: F.when(when, F.concat(F.lit(kind), F.col(c).cast("string")))
    projects = A.projects(spark, d).select("project_id", "group_id", F.coalesce(cron("project_id", "p", F.col("project_id") % 3 == 0), F.lit("")).alias("project_cron"))
    groups = A.groups(spark, d).select("group_id", "org_id", cron("group_id", "g", F.col("group_id") % 2 == 0).alias("group_cron"))
    orgs = A.table(spark, d, "region").select(F.col("r_regionkey").alias("org_id"), cron("r_regionkey", "o", F.col("r_regionkey") % 2 == 1).alias("org_cron"))
    return links.schedules(projects, groups, orgs)


_TRIGGERS = (*links.TRIGGER_SEVERITY, "other")


@query(f"""SELECT event_id, user_id, trigger, severity, '[' || upper(severity) || '] ' || event_type AS subject FROM (SELECT *, {_MAP('trigger', links.TRIGGER_SEVERITY, "'info'")} AS severity FROM
(SELECT event_id, event_type, {A._CASE('event_id % 6', _TRIGGERS)} AS trigger, unnest([user_id, user_id + 1]) AS user_id FROM events)) e
LEFT JOIN (SELECT c_custkey AS user_id, {A._CASE('c_custkey % 6', _TRIGGERS)} AS trigger, c_custkey % 4 <> 0 AS in_app FROM customer) p USING (user_id, trigger) WHERE coalesce(in_app, TRUE)""", plain=True)
def links_notifications(spark, d):
    events = A.table(spark, d, "events").select("event_id", F.col("event_type").alias("title"), A._pick(_TRIGGERS, F.col("event_id") % 6).alias("trigger"), F.array(F.col("user_id"), F.col("user_id") + 1).alias("user_ids"))
    prefs = A.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), A._pick(_TRIGGERS, F.col("c_custkey") % 6).alias("trigger"), (F.col("c_custkey") % 4 != 0).alias("in_app"))
    return links.fan_out(events, prefs)


def _unruled(spark, d):
    return A.findings(spark, d).withColumn("rule_id", F.when(F.col("supp") % 7 == 0, "").otherwise(F.col("rule_id")))


_RULE = "CASE WHEN supp % 7 = 0 THEN 'keyloom-' || asset_type ELSE rule_id END"


@query(f"SELECT finding_id, {_RULE} AS rule, {_MAP('severity', links.ISSUE_SEVERITY, chr(39) + 'INFO' + chr(39))} AS issue_severity, CASE severity WHEN 'critical' THEN 60 WHEN 'high' THEN 30 WHEN 'medium' THEN 15 ELSE 5 END AS effort, file, CASE WHEN line > 0 THEN line END AS start_line FROM findings")
def portfolio_issues(spark, d):
    return links.issues(_unruled(spark, d), "keyloom")


@query(f"SELECT scan_id, rule, name, {_MAP('severity', links.ISSUE_IMPACT, chr(39) + 'LOW' + chr(39))} AS impact FROM (SELECT scan_id, {_RULE} AS rule, name, severity, row_number() OVER (PARTITION BY scan_id, {_RULE} ORDER BY seq, part, supp) AS k FROM findings) WHERE k = 1")
def portfolio_issue_rules(spark, d):
    return links.issue_rules(_unruled(spark, d), "keyloom", ["seq", "part", "supp"])
