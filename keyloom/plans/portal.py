"""Queries of the portal's lists, trackers and roll-ups, and SQL for queries that had none."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import crypto as X
from keyloom.operators import portal as P
from keyloom.plans.normalising import _CERTS, certificates
from keyloom.plans.registry import _FAMILY, _POSTURE, ORACLE, WITH, YEAR, query
from keyloom.sources import adapters as A

_CIPHERS = ("RC4", "aes-256", "", "SHA-1", "KYBER")


def observed(spark, d):
    k = (F.col("event_id") % 5).cast("int")
    return A.observations(spark, d).withColumn("cipher_suite", A._pick(_CIPHERS, k))


def configured(spark, d):
    """Findings that name a version now and then, with the service and version of their properties."""
    events = ("click", "view", "purchase", "none")
    said = F.when(F.col("seq") % 3 == 0, F.concat("name", F.lit(" over TLS 1.2"))).otherwise(F.col("name"))
    return A.findings(spark, d).select("finding_id", "project_id", said.alias("name"), F.concat(F.lit("svc-"), A._pick(events, F.col("part") % 4)).alias("service_name"), F.when(F.col("seq") % 2 == 0, "1.2").alias("configured_tls"))


@query(f"""WITH {A.SQL}, o AS (SELECT *, {A._CASE('event_id % 5', _CIPHERS)} AS cipher_suite FROM observations), f AS (SELECT finding_id, project_id, CASE WHEN seq % 3 = 0 THEN name || ' over TLS 1.2' ELSE name END AS name, 'svc-' || {A._CASE('part % 4', ('click', 'view', 'purchase', 'none'))} AS service_name, CASE WHEN seq % 2 = 0 THEN '1.2' ELSE '' END AS configured FROM findings),
k AS (SELECT project_id, cipher_suite, tls_version, min(event_id) AS nth FROM o GROUP BY ALL), n AS (SELECT finding_id, k.tls_version, k.cipher_suite FROM f JOIN k USING (project_id) WHERE cipher_suite <> '' AND contains(upper(name), upper(cipher_suite)) OR contains(lower(name), 'tls ' || tls_version) QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY nth) = 1),
l AS (SELECT project_id, service_name, tls_version, cipher_suite FROM o QUALIFY row_number() OVER (PARTITION BY project_id, service_name ORDER BY observed_at DESC, event_id DESC) = 1)
SELECT finding_id, coalesce(n.tls_version, l.tls_version) IS NOT NULL AS runtime_observed, coalesce(n.tls_version, l.tls_version) AS observed_tls_version, CASE WHEN n.finding_id IS NOT NULL THEN n.cipher_suite ELSE l.cipher_suite END AS observed_cipher,
coalesce(configured <> '' AND configured <> coalesce(n.tls_version, l.tls_version), FALSE) AS mismatch FROM f LEFT JOIN n USING (finding_id) LEFT JOIN l USING (project_id, service_name)""", plain=True)
def runtime_enriched(spark, d):
    return P.enrich_runtime(configured(spark, d), observed(spark, d))


_IDS = ("cbom-md5-weak", "cbom-aes-ecb", "cbom-rsa-keygen", "x-TLS-1.0", "quantum-rsa", "hardcoded_key", "cbom-aes-gcm", "deprecated-tls-x")


@query(f"""WITH {A.SQL}, f AS (SELECT {A._CASE('part % 8', _IDS)} AS rule_id FROM findings) SELECT policy_rule, CAST(n AS BIGINT) AS violations FROM (SELECT 'no-broken-algorithms' AS policy_rule, count(*) FILTER (regexp_matches(rule_id, '(?i)md5|sha1|sha-1|des|rc4|rc2|broken')) AS n FROM f
UNION ALL SELECT 'no-ecb-mode', count(*) FILTER (rule_id ILIKE '%ecb%') FROM f UNION ALL SELECT 'rsa-min-key-size', count(*) FILTER (rule_id ILIKE '%rsa%') FROM f UNION ALL SELECT 'no-deprecated-tls', count(*) FILTER (regexp_matches(rule_id, '(?i)tls-1[.][01]|deprecated-tls|tls1_[01]')) FROM f
UNION ALL SELECT 'quantum-vulnerable', count(*) FILTER (rule_id ILIKE '%quantum%') FROM f UNION ALL SELECT 'no-hardcoded-keys', count(*) FILTER (rule_id ILIKE '%hardcoded%') FROM f)""", plain=True)
def policy_violation_counts(spark, d):
    return P.violation_counts(A.findings(spark, d).select(A._pick(_IDS, F.col("part") % 8).alias("rule_id")))


@query(f"""SELECT l_orderkey, l_linenumber, days AS days_remaining, CASE WHEN days < 0 THEN 'black' WHEN days < 30 THEN 'red' WHEN days <= 90 THEN 'amber' ELSE 'green' END AS status_color
FROM (SELECT *, CAST(floor((epoch(not_after) - epoch(TIMESTAMP '1997-06-01 12:00:00')) / 86400) AS INTEGER) AS days FROM ({_CERTS}))""", plain=True)
def portal_certificates(spark, d):
    out = P.certificate_tracker(certificates(spark, d), F.lit("1997-06-01 12:00:00").cast("timestamp"))
    return out.select("l_orderkey", "l_linenumber", "days_remaining", "status_color")


_KEY_ALGS = ("RSA", "", "ECDSA")


@query(f"""WITH c AS (SELECT l_orderkey || '-' || l_linenumber AS id, signature, {A._CASE('l_orderkey % 3', _KEY_ALGS)} AS k FROM ({_CERTS})) SELECT DISTINCT 'cert:' || id AS ref, 'alg:' || signature AS depends_on FROM c UNION SELECT 'cert:' || id, 'key:' || id FROM c WHERE k <> '' UNION SELECT 'key:' || id, 'alg:' || k FROM c WHERE k <> ''""", plain=True)
def links_certificate_graph(spark, d):
    rows = certificates(spark, d).select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("cert_id"), "signature", A._pick(_KEY_ALGS, F.col("l_orderkey") % 3).alias("key_algorithm"))
    return P.certificate_graph(rows)


_SCORES = f"SELECT completed_at AS time, CASE WHEN scan_id % 2 = 0 THEN 'nist' ELSE 'fips' END AS framework, project_id, CAST(scan_id % 101 AS DOUBLE) AS score, scan_id % 7 AS compliant, scan_id % 3 AS non_compliant FROM scans WHERE scan_status = 'completed'"


def scores(spark, d):
    s = A.scans(spark, d).where("scan_status = 'completed'")
    return s.select(F.col("completed_at").alias("time"), F.when(F.col("scan_id") % 2 == 0, "nist").otherwise("fips").alias("framework"), "project_id", (F.col("scan_id") % 101).cast("double").alias("score"), (F.col("scan_id") % 7).alias("compliant"), (F.col("scan_id") % 3).alias("non_compliant"))


@query(f"WITH {A.SQL} SELECT strftime(time, '%Y-%m-%d') AS day, framework, project_id, round_even(CAST(sum(CAST(round(score * 10) AS BIGINT)) AS DOUBLE) / (10 * count(score)), 4) AS avg_score, CAST(sum(compliant) AS BIGINT) AS compliant, CAST(sum(non_compliant) AS BIGINT) AS non_compliant FROM ({_SCORES}) GROUP BY 1, 2, 3", plain=True)
def compliance_daily(spark, d):
    return P.daily_compliance(scores(spark, d)).withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "avg_score": F.bround("avg_score", 4)})


@query(f"WITH {A.SQL} SELECT strftime(CAST(time AS DATE), '%Y-%m-%d') AS day, project_id, round_even(CAST(sum(CAST(round(score * 10) AS BIGINT)) AS DOUBLE) / (10 * count(score)), 1) AS score, CAST(sum(compliant) AS BIGINT) AS compliant, CAST(sum(non_compliant) AS BIGINT) AS non_compliant FROM ({_SCORES}) WHERE framework = 'nist' GROUP BY CAST(time AS DATE), project_id HAVING CAST(time AS DATE) >= TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 90 DAY", plain=True)
def compliance_trend(spark, d):
    return P.compliance_trend(P.daily_compliance(scores(spark, d)), "nist", "90d", "1998-08-02 00:00:00").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_NIST_OF = """CASE WHEN family IN ('des', '3des', 'rc4', 'md5', 'sha1') THEN 3.0 WHEN family = 'rsa' THEN CASE WHEN key_size >= 2048 THEN 1.0 ELSE 3.0 END WHEN family = 'dh' THEN CASE WHEN key_size < 2048 THEN 3.0 ELSE 1.0 END WHEN family IN ('ecdsa', 'ecdh', 'ecc', 'dsa') THEN 1.0
WHEN family = 'aes' THEN CASE WHEN key_size < 128 THEN 3.0 ELSE 0.0 END WHEN family IN ('sha256', 'sha384', 'sha512', 'sha3-256', 'sha3-384', 'sha3-512', 'ml-kem', 'ml-dsa', 'slh-dsa') THEN 0.0 ELSE 0.5 END"""


@query(f"""WITH {A.SQL}, ff AS (SELECT *, {_FAMILY} AS family FROM findings), fp AS (SELECT *, {_POSTURE} AS posture FROM ff), n AS (SELECT scan_id, family, count(*) OVER (PARTITION BY scan_id, family) AS n, key_size, row_number() OVER (PARTITION BY scan_id, family ORDER BY seq, part, supp) AS k FROM ff),
c AS (SELECT scan_id, greatest(0.0, round_even(100.0 - CAST(sum(n * {_NIST_OF}) AS DOUBLE) * 100.0 / (3.0 * sum(n)), 1)) AS compliance FROM n WHERE k = 1 GROUP BY 1),
r AS (SELECT scan_id, count(*) AS findings, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, least(100.0, round_even(CAST(sum(CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 7.0 WHEN 'low' THEN 1.0 ELSE 4.0 END * CASE posture WHEN 'broken' THEN 2.0 WHEN 'vulnerable' THEN 1.0 WHEN 'safe' THEN 0.0 ELSE 0.5 END) AS DOUBLE) * 100.0 / (count(*) * 20.0), 1)) AS quantum_risk FROM fp GROUP BY 1)
SELECT completed_at, project_id, scan_id, findings, critical, high, quantum_risk, compliance FROM scans JOIN r USING (scan_id) JOIN c USING (scan_id) WHERE scan_status = 'completed'""", plain=True)
def portfolio_scan_metrics(spark, d):
    return P.scan_metrics(A.findings(spark, d), A.scans(spark, d))


@query(f"WITH {A.SQL} SELECT scan_id, project_id, CAST(epoch(completed_at) - epoch(completed_at - INTERVAL 1 SECOND * (scan_id % 977)) AS BIGINT) AS duration FROM scans WHERE scan_status = 'queued'", plain=True)
def portal_scan_queue(spark, d):
    s = A.scans(spark, d).withColumn("completed_at", F.col("completed_at").cast("timestamp"))
    s = s.withColumn("started_at", F.timestamp_seconds(F.unix_timestamp("completed_at") - F.col("scan_id") % 977))
    return P.scan_queue(s, status="queued").select("scan_id", "project_id", "duration")


@query("SELECT finding_id, project_id, severity, (SELECT count(*) FROM findings) AS total FROM findings ORDER BY created_at DESC, finding_id LIMIT 25 OFFSET 50")
def portal_page(spark, d):
    rows = A.findings(spark, d).select("finding_id", "project_id", "severity", "created_at")
    return P.paginate(rows, [F.desc("created_at"), "finding_id"], 3).drop("created_at")


@query("SELECT finding_id, project, name, posture FROM fp JOIN projects USING (project_id) WHERE asset_type = 'algorithm' AND posture = 'broken' AND contains(lower(name), 'des')")
def portal_assets(spark, d):
    return P.list_assets(A.findings(spark, d), A.projects(spark, d), name="DES", asset_type="algorithm", posture="broken", language="python").select("finding_id", "project", "name", "posture")


@query("SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00' AND event_type = 'click' ORDER BY ts DESC, event_id LIMIT 100", plain=True)
def portal_audit_log(spark, d):
    return P.query_audit_log(A.table(spark, d, "events"), "2024-01-05 00:00:00", "2024-01-20 00:00:00", event_type="click").select("event_id", "user_id")


def _users(spark, d):
    c = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("user_id"), F.col("s_nationkey").alias("n"))
    scope = A._pick(("org", "group", "project", "none"), F.col("user_id") % 4)
    scope_id = F.when(scope == "org", F.col("n") % 5).when(scope == "group", F.col("n")).when(scope == "project", F.col("user_id"))
    return c.select("user_id", scope.alias("scope"), scope_id.cast("long").alias("scope_id"))


@query(f"""WITH RECURSIVE {A.SQL}, u AS (SELECT s_suppkey AS user_id, s_nationkey AS n, s_suppkey % 4 AS k FROM supplier), t(root, group_id) AS (SELECT group_id, group_id FROM groups UNION ALL SELECT t.root, g.group_id FROM groups g JOIN t ON g.parent_group_id = t.group_id), p AS (SELECT project_id, group_id, org_id FROM projects JOIN groups USING (group_id))
SELECT user_id, project_id FROM u JOIN p ON k = 0 AND org_id = n % 5 UNION SELECT user_id, project_id FROM u JOIN t ON k = 1 AND root = n JOIN p USING (group_id) UNION SELECT user_id, project_id FROM u JOIN p ON k = 2 AND project_id = user_id""", plain=True)
def policy_accessible_projects(spark, d):
    groups = A.groups(spark, d)
    return P.accessible_projects(_users(spark, d), A.projects(spark, d), groups, P.descendants(groups))


_ROLES = ("org_admin", "developer", "security_engineer")
_REQ = "SELECT o_orderkey AS request_id, CASE o_orderkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'pending' ELSE 'approved' END AS request_status, o_custkey AS requested_by, CASE o_orderkey % 4 WHEN 0 THEN 'risk_accepted' WHEN 1 THEN 'other' ELSE 'false_positive' END AS request_type, CASE o_orderkey % 5 WHEN 0 THEN 'reject' ELSE 'approve' END AS decision, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey ELSE 0 END AS actor, CASE o_custkey % 3 WHEN 0 THEN 'org_admin' WHEN 1 THEN 'developer' ELSE 'security_engineer' END AS role FROM orders"


def _decided(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = A.table(spark, d, "orders")
    requests = o.select(k.alias("request_id"), F.when(k % 3 == 2, "approved").otherwise("pending").alias("request_status"), c.alias("requested_by"), A._pick(("risk_accepted", "other", "false_positive", "false_positive"), k % 4).alias("request_type"), k.alias("finding_id"))
    decisions = o.select(k.alias("request_id"), F.when(k % 5 == 0, "reject").otherwise("approve").alias("decision"), F.when(k % 7 == 0, c).otherwise(0).alias("actor"), A._pick(_ROLES, c % 3).alias("role"))
    return P.apply_request_decisions(requests, decisions, o.select(k.alias("finding_id"), F.col("o_orderstatus").alias("status")))


_ERROR = "CASE WHEN request_status <> 'pending' THEN 'already ' || request_status WHEN decision = 'approve' AND requested_by = actor THEN 'own request' WHEN role = 'developer' THEN 'role developer' END"


@query(f"SELECT request_id, decision, error, CASE WHEN error IS NOT NULL THEN request_status WHEN decision = 'approve' THEN 'approved' ELSE 'rejected' END AS status FROM (SELECT *, {_ERROR} AS error FROM ({_REQ}))", plain=True)
def policy_request_outcomes(spark, d):
    return _decided(spark, d)[0]


@query(f"SELECT request_id AS finding_id, o_orderstatus AS old_status, request_type AS new_status, 'Approved ' || request_type || ' request' AS reason FROM ({_REQ}) JOIN orders ON o_orderkey = request_id WHERE {_ERROR} IS NULL AND decision = 'approve' AND request_type <> 'other'", plain=True)
def policy_request_history(spark, d):
    return _decided(spark, d)[1]


@query("SELECT s_suppkey AS key_id, role, array_to_string(extra, ',') AS extra FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'reader' WHEN 1 THEN 'writer' ELSE 'gone' END AS role, CASE s_suppkey % 3 WHEN 0 THEN ['write'] WHEN 1 THEN CASE WHEN s_nationkey % 2 = 0 THEN ['admin'] ELSE [] END ELSE ['read', 'write'] END AS base, s_nationkey FROM supplier), (SELECT 1), LATERAL (SELECT CASE WHEN role = 'gone' THEN CASE WHEN s_nationkey % 2 = 0 THEN ['admin', 'read', 'write'] ELSE ['read', 'write'] END WHEN role = 'reader' AND s_nationkey % 2 = 0 THEN ['admin', 'write'] ELSE base END AS extra) WHERE len(extra) > 0", plain=True)
def policy_over_scoped(spark, d):
    scopes = F.array_compact(F.array(F.lit("read"), F.lit("write"), F.when(F.col("s_nationkey") % 2 == 0, "admin")))
    keys = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("key_id"), A._pick(("reader", "writer", "gone"), F.col("s_suppkey") % 3).alias("role"), scopes.alias("scopes"))
    roles = spark.range(1).select(F.inline(F.array(F.struct(F.lit("reader").alias("role"), F.array(F.lit("read")).alias("allowed")), F.struct(F.lit("writer").alias("role"), F.array(F.lit("read"), F.lit("write")).alias("allowed")))))
    return P.over_scoped(keys, roles).select("key_id", "role", F.array_join("extra", ",").alias("extra"))


@query("SELECT scan_id, project_id, CAST(count(*) OVER (PARTITION BY project_id) - place + 1 AS INTEGER) AS number FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY completed_at DESC, scan_id DESC) AS place FROM scans WHERE scan_status = 'completed') WHERE place <= 50")
def drift_scan_numbers(spark, d):
    return P.scan_numbers(A.scans(spark, d)).select("scan_id", "project_id", F.col("number").cast("int").alias("number"))


@query("SELECT finding_id, 'FIND-' || row_number() OVER (PARTITION BY scan_id ORDER BY file, line, rule_id, finding_id) AS number FROM findings")
def detect_finding_numbers(spark, d):
    return P.number_findings(A.findings(spark, d)).select("finding_id", "number")


_SENT = "SELECT o_orderkey AS request_id, o_custkey AS project_id, 'c' || (o_orderkey % 3) AS commit_id, CAST(o_orderdate AS TIMESTAMP) AS created_at, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN CASE WHEN CAST(o_orderdate AS TIMESTAMP) < TIMESTAMP '1997-01-01 00:00:00' THEN 'failed' ELSE 'queued' END ELSE 'running' END AS state FROM orders"


@query(f"WITH r AS ({_SENT}), l AS (SELECT project_id, commit_id, arg_min(request_id, (created_at, request_id)) AS existing FROM r WHERE state IN ('queued', 'running') GROUP BY 1, 2) SELECT request_id, state, coalesce(CASE WHEN state IN ('queued', 'running') THEN existing END, -1) AS answer FROM r LEFT JOIN l USING (project_id, commit_id)", plain=True)
def portal_scan_requests(spark, d):
    rows = A.table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("project_id"), F.concat(F.lit("c"), (F.col("o_orderkey") % 3).cast("string")).alias("commit"), F.col("o_orderdate").cast("timestamp").alias("created_at"),
                                              X.lookup(F.col("o_orderstatus"), {"F": "done", "O": "queued"}, "running").alias("state"))
    out = P.dedupe_scan_requests(rows, F.lit("1997-01-01 00:00:00").cast("timestamp"), patience=0)
    return out.select("request_id", "state", F.coalesce("answer", F.lit(-1)).alias("answer"))


@query("""WITH f AS (SELECT finding_id, 'lib' || (part % 3) AS library, CASE seq % 3 WHEN 0 THEN 'a/b/x.py' WHEN 1 THEN 'a/x.py' ELSE 'c/x.py' END AS file, seq % 4 AS pass FROM findings), m(library, dir, version) AS (VALUES ('lib0', '', '1'), ('lib0', 'a/', '2'), ('lib0', 'a/b/', '3'), ('lib1', 'a/', '4'))
SELECT finding_id, version AS library_version, 'pkg:generic/' || library || '@' || version AS purl FROM f LEFT JOIN (SELECT finding_id, m.version FROM f JOIN m USING (library) WHERE pass <> 3 AND starts_with(file, dir) QUALIFY row_number() OVER (PARTITION BY finding_id ORDER BY length(dir) DESC) = 1) USING (finding_id)""".replace("WITH f", f"WITH {A.SQL}, f"), plain=True)
def norm_libraries(spark, d):
    f = A.findings(spark, d).select("finding_id", F.concat(F.lit("lib"), (F.col("part") % 3).cast("string")).alias("library"), A._pick(("a/b/x.py", "a/x.py", "c/x.py"), F.col("seq") % 3).alias("file"), (F.col("seq") % 4).alias("pass"))
    rows = [F.struct(F.lit(a).alias("library"), F.lit(b).alias("dir"), F.lit(c).alias("version"), F.lit(f"pkg:generic/{a}@{c}").alias("purl")) for a, b, c in (("lib0", "", "1"), ("lib0", "a/", "2"), ("lib0", "a/b/", "3"), ("lib1", "a/", "4"))]
    return P.resolve_library(f, spark.range(1).select(F.inline(F.array(*rows)))).select("finding_id", "library_version", "purl")


@query("SELECT finding_id, CASE WHEN seq % 2 = 0 THEN 'sha256:' || part || '!/' || path ELSE path END AS location, part % 5 = 0 AS metadata FROM (SELECT *, CASE WHEN part % 5 = 0 THEN 'var/lib/dpkg/status' || finding_id ELSE file END AS p, CASE WHEN part % 5 = 0 THEN 'var/lib/dpkg/' || finding_id ELSE file || finding_id END AS path FROM findings)")
def norm_layers(spark, d):
    f = A.findings(spark, d)
    path = F.when(F.col("part") % 5 == 0, F.concat(F.lit("var/lib/dpkg/"), "finding_id")).otherwise(F.concat("file", "finding_id"))
    layers = f.where("seq % 2 = 0").select(path.alias("file"), F.concat(F.lit("sha256:"), F.col("part").cast("string")).alias("digest")).distinct()
    return P.stamp_layers(f.select("finding_id", path.alias("file")), layers).select("finding_id", "location", "metadata")


@query("SELECT finding_id FROM findings WHERE seq % 3 = 0 OR seq % 3 = 1 AND file IN (SELECT file FROM findings WHERE part % 2 = 0) OR seq % 3 = 2 AND file IN (SELECT file FROM findings WHERE supp % 7 = 0)")
def detect_import_gate(spark, d):
    f = A.findings(spark, d)
    needs = F.when(F.col("seq") % 3 == 1, "hashlib").when(F.col("seq") % 3 == 2, "ssl")
    imports = f.where("part % 2 = 0").select("file", F.lit("hashlib").alias("module")).unionByName(f.where("supp % 7 = 0").select("file", F.lit("ssl").alias("module")))
    return P.import_gate(f.select("finding_id", "file", needs.alias("needs")), imports).select("finding_id")


@query("""SELECT path, name, use_line, value FROM (SELECT u.path, u.name, u.line AS use_line, a.value, row_number() OVER (PARTITION BY u.path, u.name, u.line ORDER BY a.line DESC, a.value DESC) AS k FROM (SELECT DISTINCT scan_id AS path, 'v' || (supp % 3) AS name, seq * 2 AS line FROM findings WHERE seq > 1) u
JOIN (SELECT scan_id AS path, 'v' || (supp % 3) AS name, seq * 2 - 1 AS line, name AS value FROM findings) a ON u.path = a.path AND u.name = a.name AND a.line < u.line) WHERE k = 1""")
def detect_assign_then_use(spark, d):
    f = A.findings(spark, d)
    var = F.concat(F.lit("v"), (F.col("supp") % 3).cast("string"))
    assignments = f.select(F.col("scan_id").alias("path"), var.alias("name"), (F.col("seq") * 2 - 1).alias("line"), F.col("name").alias("value"))
    uses = f.where("seq > 1").select(F.col("scan_id").alias("path"), var.alias("name"), (F.col("seq") * 2).alias("line")).distinct()
    return P.assign_then_use(assignments, uses).select("path", "name", "use_line", "value")


@query("""SELECT field, n, examples FROM (SELECT field, count(*) AS n FROM m GROUP BY 1) JOIN (SELECT field, string_agg(finding_id, ',' ORDER BY finding_id) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY finding_id) AS k FROM m) WHERE k <= 10 GROUP BY 1) USING (field)""".replace("SELECT field, n", f"WITH {A.SQL}, m AS (SELECT finding_id, 'severity' AS field FROM findings WHERE severity NOT IN ('critical', 'high', 'medium') UNION ALL SELECT finding_id, 'asset_type' FROM findings WHERE asset_type = 'protocol') SELECT field, n", 1), plain=True)
def norm_tally(spark, d):
    return P.normalization_tally(A.findings(spark, d), {"severity": ("critical", "high", "medium"), "asset_type": ("algorithm", "certificate", "related-crypto-material"), "status": ("open", "resolved", "in_review", "false_positive")})


@query("SELECT p_partkey AS rule_id FROM part WHERE p_partkey % 3 = 1 AND p_size % 2 = 0", plain=True)
def policy_rules_listed(spark, d):
    rules = A.table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), A._pick(("security", "inventory", "other"), F.col("p_partkey") % 3).alias("category"), F.lit("stable").alias("maturity"), (F.col("p_size") % 2 == 0).alias("default_enabled"))
    return P.list_rules(rules, category="inventory", maturity="stable", enabled=True).select("rule_id")


_STEP = lambda x, *b: f"CASE WHEN {x} <= {b[0]} THEN 100.0 WHEN {x} <= {b[1]} THEN 75.0 WHEN {x} <= {b[2]} THEN 50.0 WHEN {x} <= {b[3]} THEN 25.0 ELSE 0.0 END"


@query(f"""WITH {A.SQL}, ff AS (SELECT *, {_FAMILY} AS family FROM findings), b AS (SELECT project_id, count(*) AS calls, count(DISTINCT file) AS files, count(*) FILTER (part % 3 = 0 OR seq % 4 > 1) AS wrapped, count(DISTINCT family) FILTER (family <> 'unknown') AS algs, count(*) FILTER (supp % 4 = 0) AS kms, count(*) FILTER (supp % 4 = 1 AND part % 10 = 0) AS hard, count(*) FILTER (supp % 4 = 2) AS conf,
count(*) FILTER (family IN ({", ".join(f"'{x}'" for x in (*X.MIGRATION, *X.SAFE))})) AS repl, count(*) FILTER (family <> 'unknown') AS known FROM ff GROUP BY 1),
s AS (SELECT project_id, {_STEP('files', 3, 10, 25, 50)} AS concentration, CASE WHEN wrapped = calls THEN 100.0 WHEN wrapped / calls >= 0.7 THEN 75.0 WHEN wrapped / calls >= 0.3 THEN 50.0 WHEN wrapped > 0 THEN 25.0 ELSE 0.0 END AS abstraction, {_STEP('algs', 2, 5, 10, 20)} AS diversity,
CASE WHEN kms + hard + conf = 0 OR hard + conf = 0 THEN 100.0 WHEN kms / (kms + hard + conf) >= 0.5 THEN 75.0 WHEN hard = 0 THEN 50.0 WHEN hard / (kms + hard + conf) < 0.5 THEN 25.0 ELSE 0.0 END AS key_management, CASE WHEN known = 0 OR repl = known THEN 100.0 WHEN repl / known >= 0.75 THEN 75.0 WHEN repl / known >= 0.5 THEN 50.0 WHEN repl / known >= 0.25 THEN 25.0 ELSE 0.0 END AS readiness, hard AS n_hardcoded FROM b),
t AS (SELECT *, round_even(CAST(concentration AS DOUBLE) * 0.2::DOUBLE + CAST(abstraction AS DOUBLE) * 0.25::DOUBLE + CAST(diversity AS DOUBLE) * 0.15::DOUBLE + CAST(key_management AS DOUBLE) * 0.2::DOUBLE + CAST(readiness AS DOUBLE) * 0.2::DOUBLE, 1) AS score FROM s)
SELECT project_id, CAST(concentration AS DOUBLE) AS concentration, CAST(abstraction AS DOUBLE) AS abstraction, CAST(diversity AS DOUBLE) AS diversity, CAST(key_management AS DOUBLE) AS key_management, CAST(readiness AS DOUBLE) AS readiness, n_hardcoded, score, CASE WHEN score >= 80 THEN 'Highly Agile' WHEN score >= 60 THEN 'Moderately Agile' WHEN score >= 40 THEN 'Limited Agility' ELSE 'Rigid' END AS label FROM t""", plain=True)
def risk_agility(spark, d):
    where = F.when(F.col("supp") % 4 == 0, "KMS").when((F.col("supp") % 4 == 1) & (F.col("part") % 10 == 0), "hardcoded").when(F.col("supp") % 4 == 2, "env")
    return P.agility(A.findings(spark, d).withColumns({"is_wrapper": F.col("part") % 3 == 0, "call_depth": (F.col("seq") % 4).cast("int"), "key_management": where}))


_CLASS = lambda a, b, c, e: f"CASE classification WHEN 'public' THEN {a} WHEN 'internal' THEN {b} WHEN 'confidential' THEN {c} ELSE {e} END"
_LEFT = max(0, 2035 - YEAR)
ORACLE["risk_hndl"] = WITH + f"""SELECT *, CASE WHEN risk >= 0.8 OR mosca AND exposure > 0 THEN 'URGENT' WHEN risk >= 0.5 THEN 'HIGH' WHEN risk >= 0.2 THEN 'MEDIUM' ELSE 'LOW' END AS urgency FROM (SELECT project_id, classification, round_even(e, 8) AS exposure, round_even({_CLASS(0.1, 0.4, 0.7, 1.0)}::DOUBLE * e * {min(1.0, max(0.0, 1 - _LEFT / 15))!r}::DOUBLE, 8) AS risk, {_CLASS(1, 5, 15, 25)} + 3 > {_LEFT} AS mosca
FROM (SELECT project_id, max(x) * 0.7::DOUBLE + avg(x) * 0.3::DOUBLE AS e FROM (SELECT project_id, CAST(CASE posture WHEN 'safe' THEN 0.0 WHEN 'unknown' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS x FROM fp) GROUP BY 1) JOIN projects USING (project_id))"""
ORACLE["portfolio_cbom_documents"] = WITH + """SELECT scan_id, '{"bomFormat":"CycloneDX","specVersion":"1.7","version":1,"components":[' || string_agg('{"bom-ref":"' || finding_id || '","type":"cryptographic-asset","name":"' || name || '","evidence":{"occurrences":[{"location":"' || file || '","line":' || line || '}]},"properties":[{"name":"severity","value":"' || severity || '"}]}', ',' ORDER BY finding_id, name, file, line, severity) || ']}' AS value FROM findings GROUP BY 1"""
_CONF = "CASE part % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"
ORACLE["drift_dedupe_passes"] = WITH + f"""SELECT f.finding_id, f.file, f.line, f.name, CASE WHEN takes AND r2 > r1 THEN c2 ELSE confidence END AS confidence, CASE WHEN takes AND r2 > r1 THEN s2 ELSE severity END AS severity, f.description
FROM (SELECT a.*, b.c2, b.s2, b.r2, a.k = 1 AND b.r2 IS NOT NULL AS takes FROM (SELECT *, {_CONF} AS confidence, 3 - part % 3 AS r1, 'found ' || name AS description, row_number() OVER (PARTITION BY lower(file), line, lower(name) ORDER BY finding_id DESC) AS k FROM findings WHERE seq % 2 = 0) a
LEFT JOIN (SELECT lower(file) AS f, line AS l, lower(name) AS n, {_CONF} AS c2, severity AS s2, 3 - part % 3 AS r2 FROM findings WHERE seq % 2 = 1 QUALIFY row_number() OVER (PARTITION BY lower(file), line, lower(name) ORDER BY 3 - part % 3 DESC, finding_id DESC) = 1) b ON lower(a.file) = b.f AND a.line = b.l AND lower(a.name) = b.n) f
UNION ALL SELECT finding_id, file, line, name, {_CONF}, severity, 'found ' || name FROM findings x WHERE seq % 2 = 1 AND NOT EXISTS (SELECT 1 FROM findings y WHERE y.seq % 2 = 0 AND lower(y.file) = lower(x.file) AND y.line = x.line AND lower(y.name) = lower(x.name))"""
