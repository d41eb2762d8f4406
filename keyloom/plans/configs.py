"""Queries of the corpus and configuration scans, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import configs, detect
from keyloom.plans.registry import _LINES, corpus, query
from keyloom.sources import adapters as A

#: Lines of the documents with the state of their PEM blocks, then runs with what stands around them.
_MARKED = _LINES.rstrip() + r""", k AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(text, '-----BEGIN [A-Z0-9 ]+-----') THEN TRUE WHEN regexp_matches(text, '-----END [A-Z0-9 ]+-----') THEN FALSE END IGNORE NULLS) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS inside FROM lines),
a AS (SELECT path, line, text, regexp_extract_all(text, '{0}') AS t, regexp_split_to_array(text, '{0}') AS s FROM k WHERE NOT inside AND NOT contains(text, 'commit ') AND NOT contains(text, 'Commit:') AND regexp_matches(text, '{0}')),
u AS (SELECT path, line, text, t, s, unnest(range(1, len(t) + 1)) AS i FROM a), r AS (SELECT path, line, text, t[i] AS token, coalesce(CASE WHEN i > 1 THEN t[i - 1] END, '') || s[i] AS before, s[i + 1] AS after, strlen(array_to_string(s[1:i], '')) + strlen(array_to_string(t[1:i - 1], '')) + 1 AS col FROM u) """


def secrets(spark, d):
    """Every document as lines of prose between key material of its own, so that each kind of exclusion occurs."""
    docs = A.table(spark, d, "documents")
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    kinds = (F.concat(F.lit("id "), sha), F.concat(F.lit("commit "), sha), F.concat(F.lit("x-"), F.substring(sha, 1, 32)), F.concat(F.lit("Revision: "), F.substring(sha, 1, 40)), F.concat(F.lit("-----BEGIN EC KEY-----\n"), sha, F.lit("\n-----END EC KEY-----\n"), sha),
             F.concat(F.lit("sha512-"), F.base64(F.encode(sha, "utf-8"))), F.concat(F.lit("MII"), F.repeat(sha, 4)), F.concat(F.lit("-----BEGIN KEY-----\n"), sha), F.concat(F.lit("é "), F.substring(sha, 1, 40), F.lit(" "), sha))
    return docs.select(F.concat(F.lit("k/"), F.col("doc_id").cast("string")).alias("path"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), F.element_at(F.array(*kinds), (F.pmod("doc_id", F.lit(len(kinds))) + 1).cast("int"))).alias("content"))


_KINDS = ("'id ' || h", "'commit ' || h", "'x-' || h[1:32]", "'Revision: ' || h[1:40]", "'-----BEGIN EC KEY-----' || chr(10) || h || chr(10) || '-----END EC KEY-----' || chr(10) || h", "'sha512-' || base64(encode(h))", "'MII' || repeat(h, 4)", "'-----BEGIN KEY-----' || chr(10) || h", "'é ' || h[1:40] || ' ' || h")
_KEYED = _MARKED.replace("SELECT source || '/' || doc_id || '.txt' AS path, string_split(text, chr(10)) AS l FROM documents", "SELECT 'k/' || doc_id AS path, string_split(coalesce(text, '') || chr(10) || CASE doc_id % 9 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_KINDS)) + " END, chr(10)) AS l FROM (SELECT *, sha256(coalesce(text, '')) AS h FROM documents)")
_HEX, _B64 = "[0-9a-fA-F]{32,}", "[A-Za-z0-9+/]{40,}={0,2}"
_HEX_SQL = "SELECT path, line, col, token, len(token) * 4 AS bits FROM r WHERE NOT (len(token) = 32 AND (ends_with(before, '-') OR starts_with(after, '-'))) AND NOT (len(token) = 40 AND regexp_matches(lower(text), 'commit|revision|rev |sha:'))"
_B64_SQL = "SELECT path, line, col, token FROM r WHERE NOT regexp_matches(lower(before), 'sha(256|384|512)-$') AND NOT (len(token) >= 200 AND (starts_with(token, 'MII') OR starts_with(token, 'LS0tLS1CRUdJTiBDRVJUSUZJQ0FURS0tLS0t')))"


def _long(df, *columns):
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


@query(_MARKED.replace("{0}", _HEX) + _HEX_SQL, plain=True)
def detect_hex_keys(spark, d):
    return _long(detect.scan_hex_keys(detect.explode_lines(corpus(spark, d))), "line", "col", "bits")


@query(_MARKED.replace("{0}", _B64) + _B64_SQL, plain=True)
def detect_base64_keys(spark, d):
    return _long(detect.scan_base64_keys(detect.explode_lines(corpus(spark, d))), "line", "col")


@query(_KEYED.replace("{0}", _HEX) + _HEX_SQL, plain=True)
def detect_hex_keys_among_exclusions(spark, d):
    return _long(detect.scan_hex_keys(detect.explode_lines(secrets(spark, d))), "line", "col", "bits")


@query(_KEYED.replace("{0}", _B64) + _B64_SQL, plain=True)
def detect_base64_keys_among_exclusions(spark, d):
    return _long(detect.scan_base64_keys(detect.explode_lines(secrets(spark, d))), "line", "col")


_WORDS = ("MD5", "SHA1 and SHA-1", "DES, 3DES", "TripleDES", "RC4x RC4", "Blowfish", "SSLv3/TLSv1.0", "TLSv1.1 TLSv1.2", "SHA256 SHA-256", "AES128", "AES-256-GCM", "RSA_x RSA", "MD5é")
_NAMED = """CASE {0} WHEN 'MD5' THEN {1} WHEN 'SHA1' THEN {2} WHEN 'SHA-1' THEN {2} WHEN 'DES' THEN {3} WHEN '3DES' THEN {4} WHEN 'TripleDES' THEN {5} WHEN 'RC4' THEN {6} WHEN 'Blowfish' THEN {7} WHEN 'SSLv3' THEN {8} WHEN 'TLSv1.0' THEN {9} WHEN 'TLSv1.1' THEN {10}
 WHEN 'SHA256' THEN {11} WHEN 'SHA-256' THEN {11} WHEN 'AES128' THEN {12} WHEN 'AES-128' THEN {12} WHEN 'AES256' THEN {13} WHEN 'AES-256' THEN {13} WHEN 'RSA' THEN {14} END"""
_of = lambda *v: _NAMED.format("token", *(f"'{x}'" for x in v))
_NAMES_SQL = rf"""SELECT path, line, i - 1 AS nth, token, {_of('MD5', 'SHA-1', 'DES', '3DES', 'TripleDES', 'RC4', 'Blowfish', 'SSLv3', 'TLSv1.0', 'TLSv1.1', 'SHA-256', 'AES-128', 'AES-256', 'RSA')} AS name, {_of('md5', 'sha', 'des', 'des', 'des', 'rc4', 'blowfish', 'ssl', 'tls', 'tls', 'sha', 'aes', 'aes', 'rsa')} AS family,
{_of('hash', 'hash', *['block-cipher'] * 3, 'stream-cipher', 'block-cipher', *['protocol'] * 3, 'hash', *['block-cipher'] * 2, 'pke')} AS primitive, CASE WHEN token IN ('MD5', 'DES', 'RC4', 'SSLv3', 'TLSv1.0', 'TLSv1.1') THEN 'broken' WHEN regexp_matches(token, '^(SHA-?256|AES)') THEN 'quantum-safe' ELSE 'quantum-vulnerable' END AS quantum_status,
CASE WHEN regexp_matches(token, '^(SHA-?256|AES|RSA)') THEN 'info' ELSE 'medium' END AS severity, CASE WHEN regexp_matches(token, '^(SHA-?256|AES|RSA)') THEN 'inventory' ELSE 'security' END AS category, CASE WHEN regexp_matches(token, '^(SSL|TLS)') THEN 'protocol' ELSE 'algorithm' END AS asset_type,
'cbom-regex-algo-' || {_of('md5', 'sha-1', 'des', '3des', 'tripledes', 'rc4', 'blowfish', 'sslv3', 'tlsv10', 'tlsv11', 'sha-256', 'aes-128', 'aes-256', 'rsa')} AS rule_id
FROM (SELECT path, line, i, t[i] AS token FROM (SELECT path, line, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT path, line, regexp_extract_all(text, '\b(?:MD5|SHA-?1|DES|3DES|TripleDES|RC4|Blowfish|SSLv3|TLSv1\.0|TLSv1\.1|SHA-?256|AES-?128|AES-?256|RSA)\b') AS t FROM lines)))"""


@query(_LINES + _NAMES_SQL, plain=True)
def detect_algorithm_names(spark, d):
    return detect.scan_algorithm_names(detect.explode_lines(corpus(spark, d)))


@query(f"WITH lines AS (SELECT 'p/' || p_partkey AS path, 1 AS line, p_name || ' ' || {A._CASE('p_partkey % 13', _WORDS)} || ' ' || {A._CASE('p_size % 13', _WORDS)} AS text FROM part) " + _NAMES_SQL, plain=True)
def detect_algorithm_names_in_parts(spark, d):
    text = F.concat_ws(" ", "p_name", A._pick(_WORDS, F.col("p_partkey") % 13), A._pick(_WORDS, F.col("p_size") % 13))
    return detect.scan_algorithm_names(A.table(spark, d, "part").select(F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("path"), F.lit(1).alias("line"), text.alias("text")))


_VALUES = ("sk-live-9aQ", "true", "your_api_key_here", "<my secret>", "ab1", "ChangeMe", '""', '"quoted value"', "${TOKEN}", "%X%", "{}", "[REDACTED]", "TLSv1.2,TLSv1.1", "TLSv1.3", "SSLv3", "AES/CBC", "sha-256 with RSA", "12345", "yes", "'x'", "")
_KEYS = ("API_KEY", "db.password", "auth_token", "client.secret", "CREDENTIALS", "ssl.protocols", "cipher", "# key", "timeout", "private", "! token", "SESSION")
_V, _K = A._CASE(f"p_partkey % {len(_VALUES)}", [v.replace("'", "''") for v in _VALUES]), A._CASE(f"p_size % {len(_KEYS)}", _KEYS)
#: What the scans of values call a filler, in SQL; ``v`` is the value.
_CORE = r"""(CASE WHEN length(v) >= 2 AND (starts_with(v, '"') AND ends_with(v, '"') OR starts_with(v, '''') AND ends_with(v, '''')) THEN v[2:length(v) - 1] ELSE v END)"""
_BORING = f"""(lower({_CORE}) IN ('true', 'false', 'yes', 'no', '0', '1', 'null', 'none', 'nil', 'changeme', 'change_me', 'change-me', 'placeholder', 'todo', 'tbd', 'fixme', 'secret', 'password', 'secretkey', 'apikey', 'token', 'example', 'sample', 'test', 'dummy', 'fake', 'redacted') OR length({_CORE}) < 4
 OR lower({_CORE}) LIKE 'your%here' AND regexp_matches(lower({_CORE}), '^your[_-]') AND regexp_matches(lower({_CORE}), '[_-]here$') OR regexp_matches({_CORE}, '^([$][{{].+[}}]|[{{].+[}}]|%.+%|<.+>|\\[.+\\])$'))"""


def _file(spark, d, suffix: str, *lines):
    return A.table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(suffix)).alias("path"), F.concat_ws("\n", *lines).alias("content"))


def _assigned(sign: str):
    return F.concat(A._pick(_KEYS, F.col("p_size") % len(_KEYS)), F.lit(sign), A._pick(_VALUES, F.col("p_partkey") % len(_VALUES)))


@query(f"""SELECT path, line, 'cbom-config-hardcoded-secret' AS rule_id, 'Hardcoded secret: ' || k AS name, 'high' AS severity, CASE WHEN contains(lower(k), 'key') THEN 'secret-key' WHEN contains(lower(k), 'token') THEN 'token' WHEN contains(lower(k), 'credential') THEN 'credential' ELSE 'password' END AS detail
FROM (SELECT p_partkey || '/.env' AS path, unnest([2, 3]) AS line, unnest([trim({_K}), 'SIZE_KEY']) AS k, unnest([trim({_V}), 'of-' || p_size]) AS v FROM part) WHERE NOT starts_with(k, '#') AND regexp_matches(lower(k), '^[^#\\s].*(secret|key|password|token|auth|credential|private)') AND v <> '' AND NOT {_BORING}""", plain=True)
def detect_env_secrets(spark, d):
    return configs.scan_env(_file(spark, d, "/.env", F.lit("# secrets=none-at-all"), _assigned("="), F.concat(F.lit("  SIZE_KEY=of-"), F.col("p_size").cast("string"), F.lit("  "))))


@query(rf"""WITH l AS (SELECT p_partkey || '.properties' AS path, unnest([1, 2]) AS line, unnest([trim({_K}), 'mode']) AS k, unnest([trim({_V}), 'RC4 or ' || p_name]) AS v FROM part), f AS (SELECT *, regexp_matches(lower(k), 'secret|key|password|token|auth|credential|private') AS speaks, regexp_extract(v, '(?i)\b(TLSv1\.?[012]?|SSLv[23])\b', 1) AS tls, regexp_extract(v, '(?i)\b(AES|RSA|MD5|SHA|DES|3DES|RC4|Blowfish)\b', 1) AS alg FROM l WHERE NOT regexp_matches(k, '^[#!]'))
SELECT path, line, 'cbom-config-hardcoded-secret' AS rule_id, 'Hardcoded secret: ' || k AS name, 'high' AS severity, CASE WHEN contains(lower(k), 'key') THEN 'secret-key' WHEN contains(lower(k), 'secret') THEN 'password' WHEN contains(lower(k), 'token') THEN 'token' ELSE 'password' END AS detail FROM f WHERE speaks AND v <> '' AND NOT {_BORING}
UNION ALL SELECT path, line, 'cbom-config-tls-version', 'TLS/SSL version: ' || tls, 'medium', tls FROM f WHERE tls <> '' UNION ALL SELECT path, line, 'cbom-config-algorithm-ref', 'Algorithm reference: ' || alg, 'info', lower(alg) FROM f WHERE alg <> '' AND NOT speaks""", plain=True)
def detect_properties(spark, d):
    return configs.scan_properties(_file(spark, d, ".properties", _assigned(" : "), F.concat(F.lit("mode=RC4 or "), "p_name")))


_DIGESTS = ("sha256", "MD5", "sha-1", "SHA1")


@query(f"""WITH l AS (SELECT p_partkey || '/openssl.cnf' AS path, {A._CASE('p_partkey % 4', _DIGESTS)} AS md, p_size * 64 AS bits FROM part)
SELECT path, 3 AS line, 'cbom-configfile-openssl-weak-digest' AS rule_id, 'Weak digest: ' || CASE md WHEN 'MD5' THEN 'MD5' ELSE 'SHA-1' END AS name, 'high' AS severity, CAST(NULL AS VARCHAR) AS detail FROM l WHERE md <> 'sha256'
UNION ALL SELECT path, 4, 'cbom-configfile-openssl-weak-keysize', 'Weak key size: ' || bits || ' bits', CASE WHEN bits <= 1024 THEN 'critical' ELSE 'high' END, NULL FROM l WHERE bits < 2048""", plain=True)
def detect_openssl(spark, d):
    return configs.scan_openssl(_file(spark, d, "/openssl.cnf", F.lit("[ req ]"), F.lit("# default_md = md5"), F.concat(F.lit(" default_md = "), A._pick(_DIGESTS, F.col("p_partkey") % 4)), F.concat(F.lit("Default_Bits="), (F.col("p_size") * 64).cast("string")), F.lit("default_bits = many")))


_CIPHERS = ("RC4:!MD5:AES128-SHA", "HIGH:aNULL", "'ECDHE:DES-CBC3-SHA:3DES'")


@query(f"""WITH l AS (SELECT p_partkey || '.yaml' AS path, p_size, {A._CASE('p_partkey % 3', [c.replace("'", "") for c in _CIPHERS])} AS ciphers, 'secret-' || p_size AS s FROM part WHERE p_size % 2 = 0)
SELECT path, 3 AS line, 'cbom-configfile-k8s-tls-secret' AS rule_id, 'Kubernetes TLS secret' AS name, 'info' AS severity, CAST(NULL AS VARCHAR) AS detail FROM l UNION ALL SELECT path, 4, 'cbom-configfile-k8s-ingress-tls', 'Ingress TLS secret: ' || s, 'info', NULL FROM l
UNION ALL SELECT path, 5, 'cbom-configfile-k8s-weak-cipher', 'Weak cipher in K8s annotation: ' || c, 'high', c FROM (SELECT path, unnest(string_split(ciphers, ':')) AS c FROM l) WHERE c IN ('RC4', 'aNULL', 'DES-CBC3-SHA', '3DES')
UNION ALL SELECT path, 6, 'cbom-configfile-k8s-weak-protocol', 'Weak TLS protocol in K8s annotation: ' || p, 'high', p FROM (SELECT path, unnest(['TLSv1', 'TLSv1.1']) AS p FROM l)
UNION ALL SELECT path, 7, 'cbom-configfile-k8s-cert', 'tls.crt (k8s secret data)', 'info', sha256('certificate of ' || s || ' for the test of data') FROM l""", plain=True)
def detect_kubernetes(spark, d):
    even = F.when(F.col("p_size") % 2 == 0, "kind: Ingress").otherwise("sort: Ingress")
    secret = F.concat(F.lit("secret-"), F.col("p_size").cast("string"))
    data = F.base64(F.encode(F.concat(F.lit("certificate of "), secret, F.lit(" for the test of data")), "utf-8"))
    return configs.scan_kubernetes(_file(spark, d, ".yaml", F.lit("apiVersion: v1"), even, F.lit("type: kubernetes.io/tls"), F.concat(F.lit("    secretName: "), secret), F.concat(F.lit("  nginx/ssl-ciphers: "), A._pick(_CIPHERS, F.col("p_partkey") % 3)), F.lit("  nginx/ssl-protocols: \"TLSv1 TLSv1.1 TLSv1.3\""), F.concat(F.lit("  tls.crt: "), F.regexp_replace(data, r"\s", "")), F.lit("# kubernetes.io/tls")))
