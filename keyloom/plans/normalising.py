"""Queries of the normalisation functions over the parts table, whose keys pick from a stated list of tokens, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions import crypto as X
from keyloom.functions import normalise as N
from keyloom.plans.registry import query
from keyloom.sources import adapters as A

TOKENS = ("AES-256-GCM", "RSA-2048", "SHA-256", "aes/cbc/pkcs5padding", "TLSv1_2", "PBKDF2WithHmacSHA256", "sha3_512", "SHA512", "P-256", "secp384r1", "my variable", "ML-KEM-768", "HMAC-SHA256", "3DES_168", "x25519", "TLS_VERSION_1_3",
          "SSLv3", "AES-ECB", "kyber-768", "Blowfish", "IV", "X.509", "DES-CBC", "Argon2id", "NTRU", "chacha20-poly1305", "", "RC4-128", "DH/2048", "curve448", "SHA3256", "ed25519ph", "sha1")
RULES = ("cbom-python-md5-weak", "cbom-java-des-cipher", "cbom-java-3des-detect", "cbom-go-aes-detect", "cbom-regex-hex-key", "cbom-js-tls-10", "cbom-js-sha-128", "cbom-rust-import", "cbom-php-mcrypt", "cbom-config-algorithm-ref", "cbom-java-tripledes-des",
         "cbom-python-cert-none", "cbom-regex-base64-key", "cbom-go-rsa-keysize", "cbom-cpp-rc4-derived", "cbom-python-sha1")
GIVEN = ("", "security", "inventory")
LEVELS = ("critical", "high", "medium", "low", "info")
SIGNATURES = ("MD5-RSA", "SHA1-RSA", "ECDSA-SHA256", "SHA512-RSAPSS", "Ed25519", "DSA-SHA1", "SHA384-RSA")
FAMILIES = ("md5", "SHA1", "ed25519", "x25519", "chacha20", "rsa", "aes", "3des", "ml-kem", "foo", "sha2", "ec", "dsa", "dh", "sha-1", "des")

_TOKENS = A._CASE(f"p_partkey % {len(TOKENS)}", TOKENS)
_RULES = A._CASE(f"p_partkey % {len(RULES)}", RULES)
_PARTS = f"WITH p AS (SELECT p_partkey, {_TOKENS} AS token, {_RULES} AS rule_id, {A._CASE('p_size % 5', LEVELS)} AS severity, {A._CASE('p_size % 3', GIVEN)} AS given, {A._CASE('p_size % 4', A.ASSETS)} AS asset_type, CASE WHEN p_size % 3 = 0 THEN p_size * 8 END AS size, {A._CASE('p_partkey % 2', ('hash', 'cipher'))} AS kind, {A._CASE(f'p_size % {len(FAMILIES)}', FAMILIES)} AS family FROM part) "


def parts(spark, d):
    pick = lambda values, c: A._pick(values, F.col(c) % len(values))
    return A.table(spark, d, "part").select(
        "p_partkey", pick(TOKENS, "p_partkey").alias("token"), pick(RULES, "p_partkey").alias("rule_id"), pick(LEVELS, "p_size").alias("severity"), pick(GIVEN, "p_size").alias("given"), pick(A.ASSETS, "p_size").alias("asset_type"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_size") * 8).alias("size"), pick(("hash", "cipher"), "p_partkey").alias("kind"), pick(FAMILIES, "p_size").alias("family"))


@query(_PARTS + r"""SELECT p_partkey, rule_id, CASE WHEN given <> '' THEN given WHEN rule_id IN ('cbom-regex-hex-key', 'cbom-regex-base64-key') THEN 'inventory' ELSE own END AS category, CASE WHEN given <> '' THEN given ELSE 'stable' END AS maturity,
CASE WHEN rule_id IN ('cbom-regex-hex-key', 'cbom-regex-base64-key') THEN 'high' WHEN given <> '' THEN given ELSE 'low' END AS noise_risk, rule_id NOT IN ('cbom-regex-hex-key', 'cbom-regex-base64-key') AS default_enabled
FROM (SELECT *, CASE WHEN regexp_matches(rule_id, '-weak|-broken|-insecure|-hardcoded|-disabled|-deprecated|-ecb|-pkcs1v15|-no-?padding|-low-iter|-low-entropy|-expired|-self-signed|-cert-none|-no-?verify|-padding-oracle|-downgrade|-anonymous|-null-cipher|-export-cipher|-(?:static|zero|fixed)-iv|-reused-|-cbc-without-mac|-mac-then-encrypt|-as-password') THEN 'security'
WHEN regexp_matches(rule_id, '-(?:md5|md4|md2|sha-?1|rc4|rc2|3des|tripledes|sslv3|sslv2|tlsv10|tlsv11|tls-10|tls-11|mcrypt)(?:-|$)') THEN 'security' WHEN regexp_matches(rule_id, '-des(?:-|$)') AND NOT regexp_matches(rule_id, '-3des|-tripledes') THEN 'security'
WHEN regexp_matches(rule_id, '-imports?|-found|-asset|-detect|-library|-package|-pem-|-cipher-suite|-keysize|-curve|-certificate-parsed') THEN 'inventory' WHEN severity IN ('critical', 'high', 'medium') THEN 'security' ELSE 'inventory' END AS own FROM p)""", plain=True)
def norm_lifecycle(spark, d):
    rows = parts(spark, d).withColumns({c: F.col("given") for c in ("category", "maturity", "noise_risk")}).withColumn("default_enabled", F.lit(None).cast("boolean"))
    return N.annotate_lifecycle(rows).select("p_partkey", "rule_id", "category", "maturity", "noise_risk", "default_enabled")


_SIZE = r"""CASE WHEN NOT regexp_matches(upper(token), '^(SHA|MD[245]|HMAC|BLAKE|RIPEMD|WHIRLPOOL|SM3)') THEN coalesce(
 TRY_CAST(regexp_extract(regexp_replace(token, '[/_ -]+', '-', 'g'), '(?i)(?:^|-)(?:aes|rsa|camellia|aria|blowfish|rc2|rc4|rc5|des|3des|dh|dsa|rsaes|rsassa)-(56|64|80|112|128|160|168|192|224|256|384|512|521|1024|2048|3072|4096|8192)(?:-|$)', 1) AS INTEGER),
 TRY_CAST(regexp_extract(token, '(?i)\bp-?(256|384|521)\b', 1) AS INTEGER)) END"""
_CURVE = r"""coalesce(CASE lower(regexp_extract(token, '(?i)(secp256r1|secp384r1|secp521r1|secp256k1|prime256v1|curve25519|x25519|ed25519|x448)', 1)) WHEN '' THEN NULL WHEN 'secp384r1' THEN 384 WHEN 'secp521r1' THEN 521 WHEN 'x448' THEN 448 ELSE 256 END,
 TRY_CAST(regexp_extract(token, '(?i)\bp-?(256|384|521)\b', 1) AS INTEGER))"""


@query(_PARTS + f"SELECT p_partkey, token, coalesce(CASE WHEN size > 0 THEN size WHEN asset_type = 'algorithm' AND kind <> 'hash' THEN coalesce({_SIZE}, {_CURVE}) END, 0) AS key_size FROM p", plain=True)
def norm_key_sizes(spark, d):
    rows = parts(spark, d)
    return rows.select("p_partkey", "token", F.coalesce(N.infer_key_size(F.col("size"), F.col("asset_type"), F.col("kind"), F.col("token"), F.lit("")), F.lit(0)).alias("key_size"))


_Q = "q(name, status, level) AS (VALUES " + ", ".join(f"('{n}', '{s}', {v})" for n, s, v in N.quantum_rows()) + ")"
_BASE = lambda x: rf"lower(trim({x}))"
_CUT = lambda x: rf"regexp_replace(lower(trim({x})), '(-[a-z]*\d+(-[a-z]+)?|\d+)$', '')"


@query(_PARTS.rstrip() + f""", {_Q}, k AS (SELECT *, CASE WHEN upper(token) IN ('P-256', 'SECP384R1') THEN 'ec' WHEN upper(token) = 'ED25519PH' THEN 'ed25519' WHEN upper(token) = 'CURVE448' THEN 'ed448' ELSE token END AS f FROM p),
m AS (SELECT k.*, coalesce(a.status, b.status) AS s1, coalesce(a.level, b.level) AS l1, coalesce(c.status, e.status) AS s2, coalesce(c.level, e.level) AS l2 FROM k LEFT JOIN q a ON a.name = {_BASE('f')} LEFT JOIN q b ON b.name = {_CUT('f')}
 LEFT JOIN q c ON instr(f, '-') > 1 AND c.name = lower(split_part(f, '-', 1)) LEFT JOIN q e ON instr(f, '-') > 1 AND e.name = {_CUT("split_part(f, '-', 1)")})
SELECT p_partkey, token, CASE WHEN NOT skip THEN coalesce(s1, s2) END AS status, coalesce(CASE WHEN NOT skip THEN CASE WHEN s1 IS NOT NULL THEN l1 ELSE l2 END END, 0) AS level FROM (SELECT *, token = '' OR asset_type IN ('certificate', 'related-crypto-material') AND NOT upper(token) IN ('TLS') OR upper(token) IN ('IV', 'X.509') AS skip FROM m)""", plain=True)
def norm_quantum(spark, d):
    rows = parts(spark, d)
    found = N.annotate_quantum(F.lit(None).cast("string"), F.col("token"), F.col("asset_type"), F.lit(None).cast("string"), F.lit(None).cast("int"))
    return rows.select("p_partkey", "token", found.alias("q")).select("p_partkey", "token", "q.status", F.coalesce("q.level", F.lit(0)).alias("level"))


@query(_PARTS + r"""SELECT p_partkey, token, CASE WHEN u = '' THEN NULL WHEN contains(u, '/') AND regexp_matches(split_part(u, '/', 2), '^(ECB|CBC|GCM|CTR|CFB|OFB|CCM|XTS|SIV|KW)$') THEN split_part(u, '/', 1) || '-' || split_part(u, '/', 2)
 WHEN starts_with(w, 'TLSV') THEN 'TLS-' || replace(w[5:], '-', '.') WHEN starts_with(w, 'TLS-VERSION-') THEN 'TLS-' || replace(w[13:], '-', '.') WHEN starts_with(w, 'SSLV') THEN 'SSL-' || replace(w[5:], '-', '.')
 WHEN starts_with(w, 'PBKDF2WITHHMAC') THEN CASE WHEN w[15:] = '' THEN 'PBKDF2-HMAC' ELSE 'PBKDF2-HMAC-' || ltrim(w[15:], '-') END WHEN regexp_matches(w, '^SHA[0-9]+$') AND NOT starts_with(w, 'SHA3') THEN 'SHA-' || w[4:] WHEN regexp_matches(w, '^SHA3[0-9]+$') THEN 'SHA3-' || w[5:]
 WHEN length(w) <= 40 AND NOT regexp_matches(w, '[\s"''`()=]') AND regexp_matches(w, '^(?:MD|SHA|AES|3?DES|RC|RSA|DSA|DH|EC|ED|X25519|X448|CURVE|SECP|BLOWFISH|CHACHA|HMAC|SSL|TLS|ARGON|KYBER|ML-KEM|NTRU|X\.509|PBKDF)') THEN w END AS primitive,
 coalesce(nullif(regexp_extract(trim(upper(token)), '^(?:ML-KEM|ML-DSA|SLH-DSA|KYBER|DILITHIUM|FALCON|SPHINCS)-(.*)$', 1), ''), list_filter(string_split(trim(upper(token)), '-'), lambda x: regexp_matches(x, '^[0-9]+$'))[1], CASE WHEN size > 0 THEN CAST(size AS VARCHAR) END) AS parameter_set
FROM (SELECT *, upper(trim(token)) AS u, replace(split_part(upper(trim(token)), '/', 1), '_', '-') AS w FROM p)""", plain=True)
def norm_primitives(spark, d):
    return parts(spark, d).select("p_partkey", "token", N.canonical_primitive(F.col("token")).alias("primitive"), N.parameter_set(F.col("token"), F.col("size")).alias("parameter_set"))


_CANON = ("AES-256", "aes_128", "not a token", "", "SHA256", "my_var")


@query(f"""WITH t AS (SELECT p_partkey, {A._CASE('p_partkey % 6', _CANON)} AS a, {A._CASE('p_size % 6', _CANON)} AS b, {A._CASE('(p_partkey + p_size) % 6', _CANON)} AS c FROM part),
m(raw, canon) AS (VALUES ('AES-256', 'AES-256'), ('aes_128', 'AES-128'), ('SHA256', 'SHA-256')) SELECT p_partkey, coalesce(x.canon, nullif(a, ''), y.canon, z.canon, nullif(c, '')) AS primitive FROM t LEFT JOIN m x ON a = x.raw LEFT JOIN m y ON b = y.raw LEFT JOIN m z ON c = z.raw""", plain=True)
def norm_resolved_primitives(spark, d):
    pick = lambda i: A._pick(_CANON, i % 6)
    k, s = F.col("p_partkey"), F.col("p_size")
    return A.table(spark, d, "part").select("p_partkey", N.resolve_primitive(pick(k), pick(s), pick(k + s)).alias("primitive"))


_SAID = ("ERROR", "Warning ", "info", "", "med", "HIGH", "experimental", "Inventory", "custom-type")


@query(f"""WITH t AS (SELECT p_partkey, {A._CASE('p_partkey % 9', _SAID)} AS s, CASE p_size % 3 WHEN 0 THEN NULL WHEN 1 THEN TRUE ELSE FALSE END AS e FROM part)
SELECT p_partkey, CASE s WHEN 'ERROR' THEN 'high' WHEN 'Warning ' THEN 'medium' ELSE 'info' END AS severity, CASE s WHEN 'HIGH' THEN 'high' ELSE 'medium' END AS confidence, CASE s WHEN '' THEN 'algorithm' ELSE s END AS asset_type,
CASE s WHEN 'Inventory' THEN 'inventory' ELSE 'security' END AS category, CASE s WHEN 'experimental' THEN 'experimental' ELSE 'stable' END AS maturity, CASE s WHEN 'med' THEN 'medium' WHEN 'HIGH' THEN 'high' ELSE 'low' END AS noise_risk, coalesce(e, TRUE) AS default_enabled FROM t""", plain=True)
def norm_engine_fields(spark, d):
    said = A._pick(_SAID, F.col("p_partkey") % 9)
    enabled = F.when(F.col("p_size") % 3 == 1, True).when(F.col("p_size") % 3 == 2, False)
    rows = A.table(spark, d, "part").select("p_partkey", *(said.alias(c) for c in ("severity", "confidence", "asset_type", "category", "maturity", "noise_risk")), enabled.alias("default_enabled"))
    return N.map_engine_fields(rows)


@query(_PARTS + """SELECT p_partkey, family, posture, CASE posture WHEN 'broken' THEN 'critical' WHEN 'vulnerable' THEN 'medium' ELSE 'info' END AS severity, CASE WHEN posture = 'broken' THEN 'critical' WHEN posture = 'safe' THEN 'none' WHEN posture = 'vulnerable' THEN CASE WHEN kind = 'hash' THEN 'medium' ELSE 'critical' END END AS priority
FROM (SELECT *, CASE WHEN lower(family) IN ('md5', 'sha1', 'des', '3des', 'rc4') THEN 'broken' WHEN lower(family) IN ('rsa', 'ecdsa', 'ecdh', 'dsa', 'dh', 'ec', 'ed25519', 'ed448', 'x25519', 'x448') THEN 'vulnerable' WHEN lower(family) IN ('ml-kem', 'aes', 'sha2', 'chacha20') THEN 'safe' ELSE 'unknown' END AS posture FROM p)""", plain=True)
def norm_postures(spark, d):
    rows = parts(spark, d).withColumn("posture", N.infer_posture(F.col("family")))
    primitive = F.when(F.col("kind") == "hash", "hash").otherwise("pke")
    return rows.select("p_partkey", "family", "posture", X.posture_severity(F.col("posture")).alias("severity"), X.quantum_priority(F.col("posture"), primitive).alias("priority"))


@query(_PARTS + """SELECT p_partkey, family, CASE WHEN kind = 'hash' THEN 'URGENT: Replace immediately. This algorithm is broken by classical attacks.' WHEN lower(family) LIKE '%rsa%' THEN 'Migrate to ML-KEM (FIPS 203) for key encapsulation or ML-DSA (FIPS 204) for signatures.'
WHEN lower(family) LIKE '%ec%' THEN 'Migrate to ML-DSA (FIPS 204) for signatures or ML-KEM (FIPS 203) for key exchange.' WHEN lower(family) LIKE '%dsa%' THEN 'Migrate to ML-DSA (FIPS 204) for digital signatures.' WHEN lower(family) LIKE '%dh%' THEN 'Migrate to ML-KEM (FIPS 203) for key encapsulation.'
WHEN lower(family) LIKE '%aes%' THEN 'Increase key size to AES-256. AES-256 provides adequate quantum resistance.' WHEN lower(family) LIKE '%sha%' AND lower(family) LIKE '%1%' THEN 'Migrate to SHA-256 or SHA-3. Current algorithm is weak against classical attacks.'
WHEN lower(family) = 'md5' THEN 'URGENT: Replace with SHA-256 or SHA-3. MD5 is broken by classical attacks.' WHEN lower(family) LIKE '%des%' THEN 'URGENT: Replace with AES-256-GCM. DES/3DES is no longer considered secure.' ELSE 'Evaluate NIST PQC standards (FIPS 203/204/205) for quantum-safe replacement.' END AS advice FROM p""", plain=True)
def norm_recommendations(spark, d):
    status = F.when(F.col("kind") == "hash", "broken").otherwise("quantum-vulnerable")
    return parts(spark, d).select("p_partkey", "family", N.quantum_recommendation(F.col("family"), status).alias("advice"))


_SIZES = ("2048", "", "x", "256")


@query(f"""WITH t AS (SELECT p_partkey, {A._CASE('p_partkey % 4', _SIZES)} AS a, {A._CASE('p_size % 4', _SIZES)} AS b FROM part) SELECT p_partkey, coalesce(TRY_CAST(coalesce(nullif(a, ''), b) AS INTEGER), 0) AS key_size FROM t""", plain=True)
def norm_given_sizes(spark, d):
    return A.table(spark, d, "part").select("p_partkey", F.coalesce(N.key_size_of(A._pick(_SIZES, F.col("p_partkey") % 4), A._pick(_SIZES, F.col("p_size") % 4)), F.lit(0)).alias("key_size"))


_CERTS = f"SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS TIMESTAMP) AS not_before, CAST(l_shipdate AS TIMESTAMP) + CAST(l_quantity AS INTEGER) * 10 * INTERVAL 1 DAY AS not_after, {A._CASE(f'l_suppkey % {len(SIGNATURES)}', SIGNATURES)} AS signature, list_transform(range(1, CAST(l_quantity AS BIGINT) % 14 + 1), lambda i: 'DNS:h' || i) AS sans FROM lineitem"


def certificates(spark, d):
    """One certificate a line item, valid from its shipping for ten days a piece."""
    k = (F.col("l_quantity").cast("long") % 14).cast("int")
    names = F.transform(F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("DNS:h"), i.cast("string")))
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("timestamp").alias("not_before"), F.expr("CAST(l_shipdate AS TIMESTAMP) + make_dt_interval(CAST(l_quantity AS INT) * 10)").alias("not_after"), A._pick(SIGNATURES, F.col("l_suppkey") % len(SIGNATURES)).alias("signature"), names.alias("sans"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN not_after < n THEN 'expired' WHEN not_after < n + INTERVAL 30 DAY THEN 'expiring-soon' ELSE 'active' END AS state, CASE WHEN not_after < n THEN 'high' WHEN not_after < n + INTERVAL 30 DAY THEN 'medium' ELSE 'info' END AS severity,
CASE WHEN not_after < n + INTERVAL 30 DAY THEN 'security' ELSE 'inventory' END AS category, CAST(greatest(0, date_diff('day', not_before, not_after)) AS INTEGER) AS validity_days, CASE WHEN len(sans) > 10 THEN array_to_string(sans[1:10], ',') || ',(+' || (len(sans) - 10) || ' more)' ELSE array_to_string(sans, ',') END AS names,
CASE signature WHEN 'MD5-RSA' THEN 'MD5' WHEN 'SHA1-RSA' THEN 'SHA-1' WHEN 'DSA-SHA1' THEN 'SHA-1' WHEN 'ECDSA-SHA256' THEN 'SHA-256' WHEN 'SHA384-RSA' THEN 'SHA-384' WHEN 'SHA512-RSAPSS' THEN 'SHA-512' ELSE '' END AS digest FROM ({_CERTS}), (SELECT TIMESTAMP '1997-06-01 00:00:00' AS n)""", plain=True)
def norm_certificates(spark, d):
    rows = N.certificate_state(certificates(spark, d), F.lit("1997-06-01 00:00:00").cast("timestamp"))
    return rows.select("l_orderkey", "l_linenumber", "state", "severity", "category", "validity_days", F.array_join("sans", ",").alias("names"), N.signature_hash(F.col("signature")).alias("digest"))
