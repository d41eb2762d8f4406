"""Queries of the roll-ups and of the scans of calls, wrappers and server configurations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import crypto as X
from keyloom.operators import detect, rollups
from keyloom.plans.registry import _WEIGHT, ORACLE, WITH, _class_sql, _more, query
from keyloom.operators import frameworks
from keyloom.sources import adapters as A


def _plain(name: str) -> str:
    """The SQL of another query as a sub-query."""
    return f"({ORACLE[name]})"


_GOOD = lambda k: f"SELECT project_id, CAST(sum(n) AS BIGINT) AS a, CAST(sum(CASE WHEN {_class_sql(k)} = '{frameworks.FRAMEWORKS[k]['good']}' THEN n ELSE 0 END) AS BIGINT) AS g FROM nist GROUP BY 1"


@query(_more(", e AS (SELECT 'nist-800-131a' AS framework, greatest(0.0, round_even(100.0 - CAST(sum(n * CASE classification WHEN 'disallowed' THEN 3.0 WHEN 'deprecated' THEN 1.0 WHEN 'unknown' THEN 0.5 ELSE 0.0 END) AS DOUBLE) * 100.0 / (3.0 * sum(n)), 1)) AS score, CAST(sum(n) FILTER (classification = 'acceptable') AS BIGINT) AS g, CAST(sum(n) FILTER (classification <> 'acceptable') AS BIGINT) AS b FROM nist GROUP BY project_id UNION ALL "
               + " UNION ALL ".join(f"SELECT '{k}', round_even(g * 100.0 / a, 1), g, a - g FROM ({_GOOD(k)})" for k in frameworks.FRAMEWORKS)
               + f" UNION ALL SELECT 'iso-27001-a8-24', round_even(count(*) FILTER (status = 'pass') * 100.0 / count(*), 1), count(*) FILTER (status = 'pass'), count(*) FILTER (status = 'fail') FROM {_plain('compliance_iso_checklist')} GROUP BY project_id"
               + f" UNION ALL SELECT 'eu-cra', round_even(count(*) FILTER (gap_status = 'no-gap') * 100.0 / count(*), 1), count(*) FILTER (gap_status = 'no-gap'), count(*) FILTER (gap_status = 'gap') FROM {_plain('compliance_cra_gaps')} GROUP BY project_id)"
               + " SELECT framework, round_even(CAST(sum(CAST(round(score * 10) AS BIGINT)) AS DOUBLE) / (10 * count(score)), 1) AS avg_score, CAST(sum(coalesce(g, 0)) AS BIGINT) AS total_compliant, CAST(sum(coalesce(b, 0)) AS BIGINT) AS total_non_compliant, count(*) AS repos_evaluated FROM e GROUP BY 1"), plain=True)
def portfolio_frameworks(spark, d):
    return rollups.portfolio_frameworks(A.findings(spark, d))


@query(_more("SELECT org_id, round_even(CAST(sum(CAST(round(score * 10) AS BIGINT)) AS DOUBLE) / (10 * count(score)), 1) AS avg_nist_score, max(last) AS last_scan_at FROM projects JOIN groups USING (group_id) LEFT JOIN (SELECT project_id, greatest(0.0, round_even(100.0 - CAST(sum(n * CASE classification WHEN 'disallowed' THEN 3.0 WHEN 'deprecated' THEN 1.0 WHEN 'unknown' THEN 0.5 ELSE 0.0 END) AS DOUBLE) * 100.0 / (3.0 * sum(n)), 1)) AS score FROM nist GROUP BY 1) USING (project_id) LEFT JOIN (SELECT project_id, max(completed_at) AS last FROM scans WHERE scan_status = 'completed' GROUP BY 1) USING (project_id) GROUP BY 1"), plain=True)
def portfolio_summary_scores(spark, d):
    return rollups.summary_scores(A.findings(spark, d), A.projects(spark, d), A.groups(spark, d), A.scans(spark, d))


@query(_more(f"SELECT project_id, risk, round_even(x * 100.0 / c, 1) AS quantum_risk_pct, round_even(g * 100.0 / c, 1) AS compliance_pct FROM (SELECT project_id, sum({_WEIGHT.format('0.0')}) AS risk, count(*) AS c, count(*) FILTER (posture IN ('broken', 'vulnerable')) AS x FROM fp GROUP BY 1 ORDER BY risk DESC, project_id LIMIT 10) JOIN (SELECT project_id, CAST(coalesce(sum(n) FILTER (classification = 'acceptable'), 0) AS BIGINT) AS g FROM nist GROUP BY 1) USING (project_id)"), plain=True)
def portfolio_top_risk_percents(spark, d):
    return rollups.top_risk_percents(A.findings(spark, d))


_TARGETS = "CASE family " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.MIGRATION.items()) + " ELSE '' END"
_BUNDLE = _more(f""", x AS (SELECT *, row_number() OVER (PARTITION BY scan_id, family ORDER BY seq, part, supp) AS nth FROM fp),
y AS (SELECT scan_id AS project_id, family, any_value(posture) AS posture, count(*) AS n, max(CASE WHEN nth = 1 THEN key_size END) AS key_size, CAST(sum(CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 7.0 WHEN 'low' THEN 1.0 ELSE 4.0 END * CASE posture WHEN 'broken' THEN 2.0 WHEN 'vulnerable' THEN 1.0 WHEN 'safe' THEN 0.0 ELSE 0.5 END) AS DOUBLE) AS raw,
 {', '.join(f"count(*) FILTER (severity = '{v}') AS n_{v}" for v in A.SEVERITIES)} FROM x GROUP BY ALL),
z AS (SELECT *, {_class_sql('fips-140-3')} AS fips, CASE WHEN family IN ('des', '3des', 'rc4', 'md5', 'sha1') THEN 'disallowed' WHEN family = 'rsa' THEN CASE WHEN key_size >= 2048 THEN 'deprecated' ELSE 'disallowed' END WHEN family = 'dh' THEN CASE WHEN key_size < 2048 THEN 'disallowed' ELSE 'deprecated' END WHEN family IN ('ecdsa', 'ecdh', 'ecc', 'dsa') THEN 'deprecated'
 WHEN family = 'aes' THEN CASE WHEN key_size < 128 THEN 'disallowed' ELSE 'acceptable' END WHEN family IN ('sha256', 'sha384', 'sha512', 'sha3-256', 'sha3-384', 'sha3-512', 'ml-kem', 'ml-dsa', 'slh-dsa') THEN 'acceptable' ELSE 'unknown' END AS classification FROM y),
g AS (SELECT project_id AS scan_id, CAST(sum(n) AS BIGINT) AS findings, {', '.join(f"CAST(sum(n_{v}) AS BIGINT) AS n_{v}" for v in A.SEVERITIES)}, least(100.0, round_even(sum(raw) * 100.0 / (20.0 * sum(n)), 1)) AS quantum_risk,
 {', '.join(f"CAST(coalesce(sum(n) FILTER ({c}), 0) AS BIGINT) AS {k}" for k, c in (("vulnerable", "posture <> 'safe'"), ("safe", "posture = 'safe'"), ("broken", "posture = 'broken'"), ("nist_compliant", "classification = 'acceptable'"), ("fips_compliant", "fips = 'approved'")))},
 greatest(0.0, round_even(100.0 - CAST(sum(n * CASE classification WHEN 'disallowed' THEN 3.0 WHEN 'deprecated' THEN 1.0 WHEN 'unknown' THEN 0.5 ELSE 0.0 END) AS DOUBLE) * 100.0 / (3.0 * sum(n)), 1)) AS nist_score,
 string_agg(family || ':' || n || ':' || coalesce(CAST(key_size AS VARCHAR), '') || ':' || posture || ':' || classification || ':' || fips || ':' || CASE WHEN posture IN ('broken', 'vulnerable') THEN {_TARGETS} ELSE '' END, ' ' ORDER BY family) AS families FROM z GROUP BY 1)
SELECT scan_id, project_id, completed_at, {', '.join(f"coalesce({c}, 0) AS {c}" for c in ("findings", *(f"n_{v}" for v in A.SEVERITIES), "quantum_risk", "vulnerable", "safe", "broken", "nist_compliant", "fips_compliant"))}, coalesce(nist_score, 100.0) AS nist_score, coalesce(round_even(fips_compliant * 100.0 / findings, 1), 100.0) AS fips_score, coalesce(families, '') AS families
FROM scans LEFT JOIN g USING (scan_id) WHERE scan_status = 'completed'""")


@query(_BUNDLE, plain=True)
def portfolio_report_bundle(spark, d):
    part = lambda x: F.concat_ws(":", x["family"], x["n"], F.coalesce(x["key_size"].cast("string"), F.lit("")), x["posture"], x["nist"], x["fips"], F.coalesce(x["target"], F.lit("")))
    return rollups.report_bundle(A.findings(spark, d), A.scans(spark, d)).withColumn("families", F.coalesce(F.array_join(F.transform("families", part), " "), F.lit("")))


@query("SELECT rule_id, total, active, round_even(fp * 100.0 / total, 2) AS fp_rate, round_even(ra * 100.0 / total, 2) AS ra_rate, round_even(fixed * 100.0 / total, 2) AS fix_rate, round_even(t, 2) AS mttr_seconds FROM (SELECT rule_id, count(*) AS total, count(*) FILTER (status IN ('open', 'in_review')) AS active, count(*) FILTER (status = 'false_positive') AS fp, 0 AS ra, count(*) FILTER (status = 'resolved') AS fixed, avg(CASE WHEN status = 'resolved' AND seq % 3 <> 0 THEN CAST(part AS DOUBLE) * 3600 END) AS t FROM (SELECT DISTINCT * FROM findings) WHERE created_at >= TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 900 DAY GROUP BY 1)")
def portfolio_rule_window(spark, d):
    f = A.findings(spark, d).distinct()
    later = lambda hours: F.timestamp_seconds(F.unix_timestamp(F.col("created_at").cast("timestamp")) + hours * 3600)
    history = f.where("seq % 3 <> 0").select("finding_id", F.lit("resolved").alias("new_status"), later(F.col("part")).alias("changed_at"))
    history = history.unionByName(f.select("finding_id", F.lit("resolved").alias("new_status"), later(F.lit(-1)).alias("changed_at")).where("false")).unionByName(f.select("finding_id", F.lit("open").alias("new_status"), later(F.lit(10**5)).alias("changed_at")))
    return rollups.rule_analytics(f, A.dealt(history, "finding_id", A.rows_of_findings(spark, d)), "900d", "1998-08-02 00:00:00")


@query("SELECT scan_id, n, completed_at AS scanned_at FROM (SELECT scan_id, count(*) AS n FROM findings WHERE rule_id = 'r-3' GROUP BY 1) JOIN scans USING (scan_id)")
def portfolio_rule_trend(spark, d):
    return rollups.rule_trend(A.findings(spark, d), A.scans(spark, d), "r-3")


@query("SELECT finding_id, severity, file, line, (SELECT count(*) FROM findings WHERE severity IN ('critical', 'high')) - 5 AS remainder FROM findings WHERE severity IN ('critical', 'high') ORDER BY severity = 'critical' DESC, file, line, finding_id LIMIT 5")
def policy_threshold_report(spark, d):
    return rollups.threshold_report(A.findings(spark, d), "high")


_SOURCES = ("x = hashlib.md5(b'1')", "y = hashlib.sha256(z); ssl.wrap_socket(s)", "# hashlib.sha1(x)", "Cipher.getInstance(\"AES/ECB/PKCS5Padding\")", "h = md5.New()", "k, _ := rsa.GenerateKey(r, 2048)", "plain(text)", "EVP_EncryptInit_ex(ctx)")
_EXTS = ("py", "java", "go", "c", "txt")
_CALLED = "(VALUES ('py', 'hashlib.md5', 'hash', 'md5', 'medium'), ('py', 'hashlib.sha256', 'hash', 'sha256', 'info'), ('py', 'ssl.wrap_socket', 'protocol', 'tls', 'medium'), ('java', 'Cipher.getInstance', 'cipher', 'unknown', 'info'), ('go', 'md5.New', 'hash', 'md5', 'medium'), ('go', 'rsa.GenerateKey', 'pke', 'rsa', 'info'), ('c', 'EVP_EncryptInit_ex', 'cipher', 'unknown', 'info')) c(ext, token, primitive, family, severity)"


def _sources(spark, d):
    part = A.table(spark, d, "part")
    pick = lambda c: A._pick(_SOURCES, F.col(c) % len(_SOURCES))
    path = F.concat(F.lit("s/"), F.col("p_partkey").cast("string"), F.lit("."), A._pick(_EXTS, (F.col("p_partkey") + F.col("p_size")) % 5))
    return part.select(path.alias("path"), F.concat(pick("p_partkey"), F.lit("\n"), pick("p_size")).alias("content"))


_SRC = f"WITH s AS (SELECT 's/' || p_partkey || '.' || {A._CASE('(p_partkey + p_size) % 5', _EXTS)} AS path, unnest([1, 2]) AS line, unnest([{A._CASE('p_partkey % 8', [x.replace(chr(39), chr(39) * 2) for x in _SOURCES])}, {A._CASE('p_size % 8', [x.replace(chr(39), chr(39) * 2) for x in _SOURCES])}]) AS text FROM part) "


@query(_SRC + f"SELECT path, line, token, primitive, family, severity FROM s JOIN {_CALLED} ON split_part(path, '.', 2) = ext AND contains(text, token || '(') AND NOT starts_with(text, '#')", plain=True)
def detect_calls(spark, d):
    return detect.scan_calls(spark, _sources(spark, d)).select("path", "line", "token", "primitive", "family", "severity")


@query(_SRC + "SELECT path, line, 'plain' AS wrapper, 'medium' AS severity FROM s WHERE contains(text, 'plain(') AND ends_with(path, '.txt')", plain=True)
def detect_wrappers(spark, d):
    wrappers = spark.range(1).select(F.lit("acme.plain").alias("wrapper"), F.lit("text").alias("language"), F.lit("medium").alias("severity"))
    return detect.scan_wrappers(detect.explode_lines(_sources(spark, d)), wrappers).select("path", "line", F.lit("plain").alias("wrapper"), "severity")


_TLS = ("ssl_protocols TLSv1 TLSv1.2;", "SSLProtocol +SSLv3 -TLSv1 +TLSv1.3", "ssl_ciphers RC4:!MD5:HIGH:aNULL;", "SSLCipherSuite \"DES-CBC3-SHA:AES256-SHA\"", "server_name x;")


@query(f"""WITH s AS (SELECT p_partkey || '/nginx.conf' AS path, 2 AS line, p_partkey % 5 AS k FROM part), t(k, token, severity) AS (VALUES (0, 'TLSv1', 'high'), (0, 'TLSv1.2', 'info'), (1, 'SSLv3', 'critical'), (1, 'TLSv1.3', 'info'), (2, 'RC4', 'high'), (2, 'aNULL', 'high'), (3, 'DES-CBC3-SHA', 'high')) SELECT path, line, token, severity FROM s JOIN t USING (k)""", plain=True)
def detect_tls_config(spark, d):
    content = F.concat(F.lit("server {\n"), A._pick(_TLS, F.col("p_partkey") % 5), F.lit("\n}"))
    files = A.table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit("/nginx.conf")).alias("path"), content.alias("content"))
    return detect.scan_tls_config(detect.explode_lines(files))
