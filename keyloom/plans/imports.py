"""Round trips of foreign results: findings are put in documents as other engines write them, some of which are broken, and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import vocabulary
from keyloom.operators import drift
from keyloom.plans.registry import query
from keyloom.sources import adapters as A
from keyloom.sources import results

_LEVELS = {"critical": "ERROR", "high": "error ", "medium": "WARNING", "low": "INFO"}


def _documents(rows, item, key: str):
    """A document a scan, of items that are written as text where they are; every eleventh lost its end, every thirteenth holds errors only."""
    items = F.array_join(F.collect_list(F.to_json(item)), ",")
    docs = rows.groupBy("scan_id").agg(F.concat(F.lit(f'{{"{key}":['), items, F.lit('],"errors":[]}')).alias("value"))
    broken = F.when(F.col("scan_id") % 11 == 0, F.substr("value", F.lit(1), F.length("value") - 2)).when(F.col("scan_id") % 13 == 0, '{"results": [], "errors": [{"message": "no rules"}]}').otherwise(F.col("value"))
    return docs.select(F.col("scan_id").cast("string").alias("source"), broken.alias("value"))


def pattern_documents(spark, d):
    f = A.findings(spark, d)
    meta = F.struct(F.col("asset_type").alias("cbom-asset-type"), F.lit("Low").alias("confidence"), F.lit("$ALGO").alias("cbom-primitive-from-metavar"))
    at = lambda c: F.struct(F.col("line").alias("line"), c.alias("col"))
    extra = F.struct(F.col("finding_id").alias("lines"), F.element_at(F.create_map(*(F.lit(x) for kv in _LEVELS.items() for x in kv)), F.col("severity")).alias("severity"), meta.alias("metadata"), F.create_map(F.lit("$ALGO"), F.struct(F.col("name").alias("abstract_content"))).alias("metavars"))
    item = F.struct(F.concat(F.lit("rules.own.cbom-python-"), "rule_id").alias("check_id"), F.col("file").alias("path"), at(F.col("seq")).alias("start"), at(F.col("seq") + 1).alias("end"), extra.alias("extra"))
    return _documents(f, item, "results")


@query(f"""WITH {A.SQL} SELECT finding_id, rule_id AS name, 'cbom-python-' || rule_id AS rule_id, file, line, seq AS col, CASE severity WHEN 'critical' THEN 'high' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' ELSE 'info' END AS severity, 'low' AS confidence, asset_type, 'security' AS category
FROM findings WHERE scan_id % 11 <> 0 AND scan_id % 13 <> 0""", plain=True)
def import_pattern_results(spark, d):
    out = results.pattern_results(pattern_documents(spark, d))
    return out.select(F.col("snippet").alias("finding_id"), "name", "rule_id", "file", "line", "col", "severity", "confidence", "asset_type", "category")


@query(f"""WITH {A.SQL} SELECT CAST(scan_id AS VARCHAR) AS source, CASE WHEN scan_id % 11 = 0 THEN 'invalid JSON' ELSE 'no results, 1 errors: no rules' END AS reason FROM (SELECT DISTINCT scan_id FROM findings) WHERE scan_id % 11 = 0 OR scan_id % 13 = 0""", plain=True)
def import_refused_results(spark, d):
    return results.refused(pattern_documents(spark, d))



@query(f"""WITH {A.SQL} SELECT finding_id, name, file, line, asset_type, CASE WHEN asset_type = 'algorithm' THEN split_part(lower(name), '-', 1) END AS family, CASE WHEN asset_type = 'algorithm' THEN key_size END AS key_size, CASE WHEN asset_type = 'protocol' THEN name END AS protocol_version,
CASE WHEN asset_type = 'certificate' THEN rule_id END AS subject, CASE WHEN asset_type = 'related-crypto-material' THEN seq END AS material_size,
CASE WHEN asset_type <> 'algorithm' THEN 'info' WHEN split_part(lower(name), '-', 1) IN ('md5', '3des', 'des', 'rc4', 'sha1') THEN 'critical' WHEN split_part(lower(name), '-', 1) IN ('rsa', 'ecdsa', 'ed25519', 'dh', 'dsa', 'ecdh') THEN 'medium' ELSE 'info' END AS severity FROM findings WHERE scan_id % 11 <> 0 AND scan_id % 13 <> 0""", plain=True)
def import_policy_documents(spark, d):
    """Components that hold the properties of all asset types; only their own show."""
    f = A.findings(spark, d)
    family = F.substring_index(F.lower("name"), "-", 1)
    crypto = F.struct(F.col("asset_type").alias("assetType"), F.struct(family.alias("algorithmFamily"), F.col("key_size").alias("classicalSecurityLevel")).alias("algorithmProperties"), F.struct(F.col("name").alias("version")).alias("protocolProperties"), F.struct(F.col("rule_id").alias("subjectName")).alias("certificateProperties"), F.struct(F.col("seq").alias("size")).alias("relatedCryptoMaterialProperties"))
    item = F.struct(F.col("finding_id").alias("bom-ref"), "name", F.struct(F.array(F.struct(F.col("file").alias("location"), "line")).alias("occurrences")).alias("evidence"), crypto.alias("cryptoProperties"))
    out = results.read_cbom_policy(_documents(f, item, "components"))
    return out.select("finding_id", "name", "file", "line", "asset_type", "family", "key_size", "protocol_version", "subject", "material_size", "severity")


def _components(rows):
    """Components with nested properties, as documents have them."""
    algorithm = F.struct(F.substring_index("name", "-", 1).alias("family"), F.col("key_size").alias("size"), F.array(F.col("status"), F.col("severity"), F.col("status")).alias("functions"))
    return rows.select("project_id", "file", F.col("rule_id").alias("ref"), F.struct(F.col("asset_type").alias("type"), algorithm.alias("algorithm")).alias("crypto"), F.create_map(F.lit("line"), F.col("line").cast("string")).alias("properties"), F.struct("scan_id", "seq", "part", "supp").alias("at"))


@query(f"""WITH {A.SQL}, c AS (SELECT project_id, file, rule_id AS ref, seq % 2 AS side, asset_type, split_part(name, '-', 1) AS family, CAST(key_size AS VARCHAR) AS size, CASE WHEN status < severity THEN status || ',' || severity ELSE severity || ',' || status END AS functions, CAST(line AS VARCHAR) AS line FROM findings
 QUALIFY row_number() OVER (PARTITION BY project_id, file, rule_id, seq % 2 ORDER BY scan_id DESC, seq DESC, part DESC, supp DESC) = 1),
j AS (SELECT coalesce(a.project_id, b.project_id) AS project_id, coalesce(a.file, b.file) AS file, coalesce(a.ref, b.ref) AS ref, a.ref IS NOT NULL AS in_a, b.ref IS NOT NULL AS in_b,
 unnest([{', '.join(f"{{'p': '{p}', 'x': b.{c}, 'y': a.{c}}}" for p, c in (('crypto.algorithm.family', 'family'), ('crypto.algorithm.functions', 'functions'), ('crypto.algorithm.size', 'size'), ('crypto.type', 'asset_type'), ('properties.line', 'line')))}]) AS v
 FROM (SELECT * FROM c WHERE side = 1) a FULL JOIN (SELECT * FROM c WHERE side = 0) b ON a.project_id = b.project_id AND a.file = b.file AND a.ref = b.ref)
SELECT project_id, file, ref, CASE WHEN NOT in_b THEN 'added' WHEN NOT in_a THEN 'removed' WHEN count(*) FILTER (v.x IS DISTINCT FROM v.y) > 0 THEN 'changed' ELSE 'unchanged' END AS change,
 CASE WHEN in_a AND in_b THEN coalesce(string_agg(v.p || ':' || coalesce(v.x, '?') || '>' || coalesce(v.y, '?'), ' ' ORDER BY v.p) FILTER (v.x IS DISTINCT FROM v.y), '') ELSE '' END AS changes FROM j GROUP BY project_id, file, ref, in_a, in_b""", plain=True)
def drift_properties(spark, d):
    """Components of odd and even findings compared property by property."""
    f = A.findings(spark, d)
    out = drift.diff_properties(_components(f.where("seq % 2 = 0")), _components(f.where("seq % 2 = 1")), ["project_id", "file", "ref"], ["crypto", "properties"], "at")
    said = F.transform("changes", lambda c: F.concat(c["property"], F.lit(":"), F.coalesce(c["before"], F.lit("?")), F.lit(">"), F.coalesce(c["after"], F.lit("?"))))
    return out.withColumn("changes", F.array_join(said, " "))


_SPELLED = {
    "family": ("AES", "rsa", " SHA-256 ", "kyber", "none such", "", "ed25519", "DH", "jwt"), "function": ("Sign", "hash", "seal", "own", "", "derive"), "material": ("IV", "symmetric-key", "scroll", "", "private-key"), "padding": ("NoPadding", "PKCS5Padding", "own", "", "OAEPWithSHA-256AndMGF1Padding"),
    "mode": ("GCM", "xts", "own", ""), "primitive": ("AEAD", "protocol", "Key-Exchange", "own", "", "hash"), "protocol": ("SSL", "TLS ", "smtp", "", "quic"),
}
_WRITTEN = {
    "family": ("AES", "RSASSA-PKCS1", "SHA-2", "ML-KEM", "", "", "EdDSA", "FFDH", "HMAC"), "function": ("sign", "digest", "encrypt", "own", "", "keyderive"), "material": ("initialization-vector", "secret-key", "other", "", "private-key"), "padding": ("raw", "pkcs5", "own", "", "oaep"),
    "mode": ("gcm", "other", "other", ""), "primitive": ("ae", "other", "key-agree", "other", "", "hash"), "protocol": ("tls", "tls", "other", "", "quic"),
}


@query("SELECT doc_id, " + ", ".join(f"{A._CASE(f'(doc_id + {k}) % {len(v)}', v)} AS {c}" for k, (c, v) in enumerate(_WRITTEN.items())) + " FROM documents", plain=True)
def norm_document_fields(spark, d):
    """Every field of the document format, for all documents."""
    docs = A.table(spark, d, "documents").select("doc_id", *(A._pick(v, (F.col("doc_id") + k) % len(v)).alias(c) for k, (c, v) in enumerate(_SPELLED.items())))
    return vocabulary.normalise_document(docs, {c: c for c in _SPELLED})[0]
