"""Queries over source code: all documents with lines of code spliced in before their text, and the rows expected of those lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import binary, code, configs, detect, rules
from keyloom.plans.registry import query
from keyloom.sources import adapters as A

#: (extension, code): document ``doc_id`` begins with the code of place ``doc_id`` modulo their number.
SNIPPETS = (
    ("py", 'import hashlib\nalgo = "md5"\nurl = "http://a#b"; hashlib.sha1(z)\nh = hashlib.new(algo)  # hashlib.md5(x)\n'),
    ("py", "KEY = b'0123'\n# Fernet(KEY)\nf = Fernet(KEY)\nrandom.random()\n"),
    ("java", 'String spec = "DES/ECB/PKCS5Padding";\n/* MessageDigest.getInstance("MD5")\n */ Cipher c = Cipher.getInstance(spec);\nMessageDigest.getInstance( "SHA-256" );\n'),
    ("java", 'KeyPairGenerator kpg = KeyPairGenerator.getInstance("RSA");\nkpg.initialize(512);\nimport javax.crypto.spec.SecretKeySpec;\n'),
    ("go", 'import "crypto/md5" # rsa.GenerateKey(r, 1)\nh := md5.New() // sha1.New()\nk, err := rsa.GenerateKey(rand.Reader, 2048)\n'),
    ("js", "const a = 'sha1';\nconst h = crypto.createHash(a);\nconst s = `x // y`; crypto.createHmac('sha256', k)\n"),
    ("c", "#include <openssl/md5.h>\nMD5_Init(&ctx); /* RSA_generate_key_ex(a) */\nint n = rand();\n"),
    ("php", "<?php $alg = 'md5'; # sha1($x)\n$h = hash($alg, $data);\nmcrypt_encrypt(MCRYPT_DES, $k, $d, MCRYPT_MODE_ECB);\n"),
    ("rb", "# Digest::MD5.hexdigest(x)\nDigest::MD5.hexdigest(x)\ncipher = OpenSSL::Cipher.new('aes-256-cbc')\n"),
    ("kt", 'val key = "secret"\nSecretKeySpec(key.toByteArray(), "AES")\nval c = Cipher.getInstance("AES/GCM/NoPadding")\n'),
    ("txt", "hashlib.md5(x)\nMD5_Init(y)\n"),
)
_EXT = [e for e, _ in SNIPPETS]


def corpus(spark, d):
    docs = A.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id") % len(SNIPPETS)
    return docs.select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit("."), A._pick(_EXT, k)).alias("path"), F.concat(A._pick([c for _, c in SNIPPETS], k), "text").alias("content"))


_PATH = f"'src/' || doc_id || '.' || {A._CASE(f'doc_id % {len(SNIPPETS)}', _EXT)}"


def _expected(columns: str, rows: list[tuple]) -> str:
    """The rows written out by place, for every document of that place."""
    said = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else "NULL" if v is None else str(v) for v in r) + ")" for r in rows)
    return f"SELECT {_PATH} AS path, {columns} FROM documents JOIN (VALUES {said}) t(k, {columns}) ON doc_id % {len(SNIPPETS)} = k"


@query(_expected("line, token, argument, primitive, family, severity", [
    (0, 3, "hashlib.sha1", "", "hash", "sha1", "medium"), (0, 4, "hashlib.new", "md5", "hash", "md5", "info"), (1, 3, "Fernet", "0123", "ae", "aes", "info"), (1, 4, "random.random", "", "drbg", "weak-random", "info"),
    (2, 3, "Cipher.getInstance", "DES/ECB/PKCS5Padding", "cipher", "des", "info"), (2, 4, "MessageDigest.getInstance", "SHA-256", "hash", "sha256", "info"), (3, 1, "KeyPairGenerator.getInstance", "RSA", "pke", "rsa", "info"),
    (4, 2, "md5.New", "", "hash", "md5", "medium"), (4, 1, "rsa.GenerateKey", "", "pke", "rsa", "info"), (4, 3, "rsa.GenerateKey", "", "pke", "rsa", "info"), (5, 2, "crypto.createHash", "sha1", "hash", "sha1", "info"), (5, 3, "crypto.createHmac", "sha256", "mac", "sha256", "info"),
    (6, 2, "MD5_Init", "", "hash", "md5", "medium"), (7, 2, "hash", "md5", "hash", "md5", "info"), (7, 3, "mcrypt_encrypt", "", "cipher", "unknown", "medium"),
    (8, 2, "Digest::MD5.hexdigest", "", "hash", "md5", "medium"), (8, 3, "OpenSSL::Cipher.new", "aes-256-cbc", "cipher", "aes", "info"), (9, 3, "Cipher.getInstance", "AES/GCM/NoPadding", "cipher", "aes", "info")]), plain=True)
def detect_call_arguments(spark, d):
    """Calls with their arguments resolved through constants, outside of comments only."""
    return detect.scan_calls(spark, corpus(spark, d)).select("path", "line", "token", "argument", "primitive", F.col("resolved_family").alias("family"), "severity")


#: A rule file's content, as a user's own: alternatives, statements in order with a shared name, literals by expression, an enclosing statement.
PACK = {"rules": [
    {"id": "own-py-md5-or-sha1", "languages": ["python"], "severity": "WARNING", "message": "Weak digest", "metadata": {"cbom-primitive": "WEAK-HASH"}, "pattern-either": [{"pattern": "hashlib.md5(...)"}, {"pattern": "hashlib.sha1(...)"}]},
    {"id": "own-py-fixed-key", "languages": ["python"], "severity": "ERROR", "message": "Key in code", "metadata": {"cbom-primitive": "KEY"}, "pattern": "$K = b\"...\"\n...\nFernet($K)"},
    {"id": "own-java-ecb", "languages": ["java", "kotlin"], "severity": "WARNING", "message": "ECB", "metadata": {"cbom-primitive": "ECB"}, "pattern": '$S = "=~/.*ECB.*/";\n...\nCipher.getInstance($S);'},
    {"id": "own-java-digest", "languages": ["java"], "severity": "INFO", "message": "Digest", "metadata": {"cbom-primitive-from-metavar": "$ALGO", "cbom-primitive-fallback": "HASH"}, "pattern": 'MessageDigest.getInstance("$ALGO")'},
    {"id": "own-java-weak-pair", "languages": ["java"], "severity": "ERROR", "message": "Short key", "metadata": {"cbom-primitive": "RSA"}, "patterns": [{"pattern": "$G.initialize(512)"}, {"pattern-inside": '$T $G = KeyPairGenerator.getInstance("RSA");'}]},
    {"id": "own-java-import", "languages": ["java"], "severity": "INFO", "message": "Library", "metadata": {"cbom-primitive": "IMPORT"}, "pattern": "import javax.crypto.$X;"},
    {"id": "own-go-md5", "languages": ["go"], "severity": "WARNING", "message": "MD5", "metadata": {"cbom-primitive": "MD5"}, "pattern": "md5.New()"},
    {"id": "own-js-mac", "languages": ["javascript"], "severity": "INFO", "message": "MAC", "metadata": {"cbom-primitive-from-metavar": "$A"}, "pattern": "crypto.createHmac('$A', ...)"},
    {"id": "own-c-rand", "languages": ["c"], "severity": "WARNING", "message": "Weak generator", "metadata": {"cbom-primitive": "WEAK-PRNG"}, "patterns": [{"pattern": "rand()"}, {"pattern": "$V = rand()"}]},
    {"id": "own-php-ecb", "languages": ["php"], "severity": "ERROR", "message": "DES in ECB", "metadata": {"cbom-primitive": "DES"}, "pattern": "mcrypt_encrypt(MCRYPT_DES, ..., MCRYPT_MODE_ECB)"},
    {"id": "own-kt-fixed-key", "languages": ["kotlin"], "severity": "ERROR", "message": "Key in code", "metadata": {"cbom-primitive": "KEY"}, "pattern": 'val $K = "..."\n...\nSecretKeySpec($K.toByteArray(...), ...)'},
]}


@query(_expected("line, rule_id, severity, primitive", [
    (0, 3, "own-py-md5-or-sha1", "WARNING", "WEAK-HASH"), (1, 3, "own-py-fixed-key", "ERROR", "KEY"), (2, 3, "own-java-ecb", "WARNING", "ECB"), (2, 4, "own-java-digest", "INFO", "SHA-256"),
    (3, 2, "own-java-weak-pair", "ERROR", "RSA"), (3, 3, "own-java-import", "INFO", "IMPORT"), (4, 2, "own-go-md5", "WARNING", "MD5"), (5, 3, "own-js-mac", "INFO", "sha256"), (6, 3, "own-c-rand", "WARNING", "WEAK-PRNG"),
    (7, 3, "own-php-ecb", "ERROR", "DES"), (9, 2, "own-kt-fixed-key", "ERROR", "KEY")]), plain=True)
def detect_rule_pack(spark, d):
    """A rule file over all documents."""
    return rules.scan_rules(corpus(spark, d), rules.compile_rules(PACK)[0]).select("path", "line", "rule_id", "severity", "primitive")


_SIGNATURES = (
    "import _VAR_ _VAR_ = _STR_ _VAR_ = _STR_; hashlib.sha1(_VAR_) _VAR_ = hashlib.new(_VAR_)", "KEY = _VAR_ _VAR_ = Fernet(KEY) random.random()", "_VAR_ = _STR_; _VAR_ = Cipher.getInstance(_VAR_); MessageDigest.getInstance(_STR_);",
    "_VAR_ = KeyPairGenerator.getInstance(_STR_); kpg.initialize(_NUM_); import javax.crypto.spec.SecretKeySpec;", "import _STR_ # rsa.GenerateKey(_VAR_, _NUM_) _VAR_ := md5.New() _VAR_, _VAR_ := rsa.GenerateKey(rand.Reader, _NUM_)",
    "_VAR_ = _STR_; _VAR_ = crypto.createHash(_VAR_); _VAR_ = _STR_; crypto.createHmac(_STR_, _VAR_)",
)


@query("SELECT doc_id, " + A._CASE(f"doc_id % {len(_SIGNATURES)}", _SIGNATURES) + " AS signature, sha256('r-7:' || coalesce(source, '') || ':' || " + A._CASE(f"doc_id % {len(_SIGNATURES)}", _SIGNATURES) + ") AS fingerprint FROM documents", plain=True)
def fingerprint_code(spark, d):
    """Signatures by language of a snippet for every document."""
    k = (F.col("doc_id") % len(_SIGNATURES)).cast("int")
    docs = A.table(spark, d, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), A._pick([c for _, c in SNIPPETS], k).alias("code"), detect.language(A._pick([f"a.{e}" for e in _EXT], k)).alias("lang"))
    signed = docs.withColumn("signature", code.signature(F.col("code"), F.col("lang")))
    return signed.select("doc_id", "signature", F.sha2(F.concat_ws(":", F.lit("r-7"), "source", "signature").cast("binary"), 256).alias("fingerprint"))


#: (hex, after the text's end): what documents hold beside their text, as bytes.
_BYTES = (
    ("637c777bf26b6fc53001672bfed7ab76ca82c97dfa5947f0add4a2af9ca472c0", ""), ("00", "2a864886f70d0101"), ("428a2f9871374491b5c0fbcfe9b5dba5", "98"), ("982f8a4291443771cffbc0b5a5dbb5e9", "608648016503040201"),
    ("78a46ad756b7c7e8db702024eecebdc1", "ffff"), ("243f6a8885a308d313198a2e03707344", "2b6570"), ("67452301efcdab8998badcfe10325476c3d2e1f0", ""), ("637c777bf26b6fc5", "01"), ("657870616e642033322d62797465206b", "2a8648ce3d0403"),
)


@query("SELECT doc_id, name, family, primitive, severity, CAST(octet_length(encode(coalesce(text, ''))) + shift AS BIGINT) AS at FROM documents JOIN (VALUES (0, 'AES S-box', 'aes', 'block-cipher', 'info', 0), (1, 'RSA identifier', 'rsa', 'pke', 'info', 1), (2, 'SHA-256 round constants', 'sha-256', 'hash', 'info', 0), "
       "(3, 'SHA-256 round constants, little-endian', 'sha-256', 'hash', 'info', 0), (4, 'MD5 table', 'md5', 'hash', 'high', 0), (5, 'Blowfish P-array', 'blowfish', 'block-cipher', 'medium', 0), (5, 'Ed25519 identifier', 'ed25519', 'signature', 'info', 16), (6, 'SHA-1 initial state', 'sha1', 'hash', 'high', 0), "
       f"(8, 'ChaCha20 constant', 'chacha20', 'stream-cipher', 'info', 0), (8, 'ECDSA identifier', 'ecdsa', 'signature', 'info', 16)) t(k, name, family, primitive, severity, shift) ON doc_id % {len(_BYTES)} = k UNION ALL "
       "SELECT doc_id, 'Ed25519 identifier', 'ed25519', 'signature', 'info', CAST(octet_length(encode(split_part(text, '+ep', 1))) AS BIGINT) FROM documents WHERE contains(text, '+ep')", plain=True)
def detect_byte_constants(spark, d):
    """Documents as bytes with constants behind their text. The identifier of Ed25519 is the text ``+ep``."""
    k = F.col("doc_id") % len(_BYTES)
    docs = A.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.concat(F.coalesce("text", F.lit("")).cast("binary"), F.unhex(A._pick([a + b for a, b in _BYTES], k))).alias("content"))
    return binary.scan_byte_constants(docs).withColumnRenamed("path", "doc_id")


#: (extension, configuration) that documents begin with.
_SERVERS = (
    ("conf", "server {\n  ssl_protocols TLSv1 TLSv1.1 TLSv1.3 SSLv3;\n  # ssl_protocols SSLv2;\n  ssl_ciphers \"RC4:!MD5:HIGH:aNULL\";\n  ssl_certificate /etc/a.pem;\n  ssl_certificate_key /etc/a.key;\n}\n"),
    ("conf", "ServerName x\nSSLProtocol all -SSLv2 +SSLv3 TLSv1 TLSv1.2\nSSLCipherSuite HIGH:!aNULL:DES-CBC3-SHA\n"), ("conf", "user = a\nprotocols are SSLv3 or so\n"),
    ("txt", "ssl_protocols SSLv3;\nssl_protocols are SSLv3 or so\n"), ("CONF", "nginx\nssl_protocols\tTLSv1.2;\nssl_ciphers HIGH;\n"),
)


@query(f"SELECT 'etc/' || doc_id || '.' || {A._CASE(f'doc_id % {len(_SERVERS)}', [e for e, _ in _SERVERS])} AS path, line, 'cbom-configfile-' || rule AS rule_id, name, severity, detail FROM documents JOIN (VALUES "
       "(0, 2, 'nginx-weak-protocol', 'Weak TLS protocol: TLSv1', 'high', 'TLSv1'), (0, 2, 'nginx-weak-protocol', 'Weak TLS protocol: TLSv1.1', 'high', 'TLSv1.1'), (0, 2, 'nginx-weak-protocol', 'Insecure protocol: SSLv3', 'critical', 'SSLv3'), "
       "(0, 4, 'nginx-weak-cipher', 'Weak cipher: RC4', 'high', 'RC4'), (0, 4, 'nginx-weak-cipher', 'Weak cipher: aNULL', 'high', 'aNULL'), (0, 5, 'nginx-certificate', 'TLS certificate: /etc/a.pem', 'info', '/etc/a.pem'), (0, 6, 'nginx-private-key', 'TLS private key: /etc/a.key', 'info', '/etc/a.key'), "
       "(1, 2, 'httpd-weak-protocol', 'Insecure protocol: SSLv3', 'critical', 'SSLv3'), (1, 2, 'httpd-weak-protocol', 'Weak TLS protocol: TLSv1', 'high', 'TLSv1'), (1, 3, 'httpd-weak-cipher', 'Weak cipher: DES-CBC3-SHA', 'high', 'DES-CBC3-SHA')) "
       f"t(k, line, rule, name, severity, detail) ON doc_id % {len(_SERVERS)} = k", plain=True)
def detect_server_configs(spark, d):
    """Server configurations before the texts of all documents."""
    k = F.col("doc_id") % len(_SERVERS)
    docs = A.table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    files = docs.select(F.concat(F.lit("etc/"), F.col("doc_id").cast("string"), F.lit("."), A._pick([e for e, _ in _SERVERS], k)).alias("path"), F.concat(A._pick([c for _, c in _SERVERS], k), "text").alias("content"))
    return configs.scan_server_config(files)
