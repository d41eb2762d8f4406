"""Detection jobs: source text x patterns -> finding rows. Frames have ``path`` and ``content``."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions.crypto import FAMILY_FULL, algorithm_family, lookup
from keyloom.operators import code

#: Where an ASCII word ends; ``\b`` would treat letters beyond ASCII as word characters.
LEFT, RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Algorithm names looked for: pattern, name, family, primitive, quantum readiness. The first ten are weak.
ALGORITHM_NAMES = (
    (r"MD5", "MD5", "md5", "hash", "broken"), (r"SHA-?1", "SHA-1", "sha", "hash", "quantum-vulnerable"), (r"DES", "DES", "des", "block-cipher", "broken"), (r"3DES", "3DES", "des", "block-cipher", "quantum-vulnerable"),
    (r"TripleDES", "TripleDES", "des", "block-cipher", "quantum-vulnerable"), (r"RC4", "RC4", "rc4", "stream-cipher", "broken"), (r"Blowfish", "Blowfish", "blowfish", "block-cipher", "quantum-vulnerable"),
    (r"SSLv3", "SSLv3", "ssl", "protocol", "broken"), (r"TLSv1\.0", "TLSv1.0", "tls", "protocol", "broken"), (r"TLSv1\.1", "TLSv1.1", "tls", "protocol", "broken"),
    (r"SHA-?256", "SHA-256", "sha", "hash", "quantum-safe"), (r"AES-?128", "AES-128", "aes", "block-cipher", "quantum-safe"), (r"AES-?256", "AES-256", "aes", "block-cipher", "quantum-safe"), (r"RSA", "RSA", "rsa", "pke", "quantum-vulnerable"),
)
WEAK_NAMES = 10
PEM_HEADERS = (("-----BEGIN RSA PRIVATE KEY-----", "high"), ("-----BEGIN EC PRIVATE KEY-----", "high"), ("-----BEGIN PRIVATE KEY-----", "high"), ("-----BEGIN ENCRYPTED PRIVATE KEY-----", "medium"), ("-----BEGIN PUBLIC KEY-----", "info"))
# Library -> package name and version banner.
LIBRARY_BANNERS = {
    "OpenSSL": ("openssl", r"OpenSSL ([0-9]+\.[0-9]+\.[0-9]+[a-z]?)"), "LibreSSL": ("libressl", r"LibreSSL ([0-9]+\.[0-9]+\.[0-9]+)"), "BoringSSL": ("boringssl", r"BoringSSL"),
    "GnuTLS": ("gnutls", r"GnuTLS ([0-9]+\.[0-9]+\.[0-9]+)"), "Mbed TLS": ("mbedtls", r"[Mm]bed ?TLS ([0-9]+\.[0-9]+\.[0-9]+)"), "wolfSSL": ("wolfssl", r"wolfSSL ([0-9]+\.[0-9]+\.[0-9]+)"),
    "libsodium": ("libsodium", r"libsodium ([0-9]+\.[0-9]+\.[0-9]+)"), "NSS": ("nss", r"NSS ([0-9]+\.[0-9]+(?:\.[0-9]+)?)"),
}
# Package installs in image recipes, the crypto packages in them, and ports of TLS endpoints.
INSTALL, OPENSSL, PINNED = r"(?:apt-get|apt|yum|dnf|microdnf|apk)\s+(?:install|add)", r"openssl", r"openssl[=-][0-9]"
CRYPTO_PACKAGES, TLS_PORTS = r"(?:libssl-dev|libssl[0-9][0-9.]*|openssl-dev|openssl-libs)", ("443", "8443")
# What java.security should disable (TLS 1.0 and 1.1 only for connections), key manager algorithms and key store types.
JAVA_WEAK = {"MD5": "high", "RC4": "high", "DES": "high", "3DES": "medium", "SSLv3": "critical"}
JAVA_WEAK_TLS = {"TLSv1": "high", "TLSv1.1": "high"}
KEY_MANAGERS = {"sunx509": "SunX509", "pkix": "PKIX", "x509": "X509", "newsunx509": "NewSunX509", "ibmx509": "IbmX509"}
KEY_STORES = {"pkcs12": "PKCS12", "jks": "JKS", "jceks": "JCEKS", "bks": "BKS", "dks": "DKS"}
# Directories that are never scanned, those of build output, file names that are left out, and the size of a fast scan.
VENDOR_DIRS = (".git", "node_modules", "vendor", ".venv", "venv", "site-packages", "bower_components", "Pods", "__pycache__", ".scannerwork", ".gradle", ".terraform", ".pytest_cache", ".idea", ".vscode")
BUILD_DIRS = ("target", "build", "dist", "out", "bin", "obj")
SKIP_GLOBS = ("*.min.js", "*.bundle.js", "*.map")
FAST_BYTES = 100 * 1024
LANGUAGES = {".py": "python", ".java": "java", ".go": "go", ".js": "javascript", ".ts": "typescript", ".kt": "kotlin", ".cs": "csharp", ".php": "php", ".rb": "ruby", ".rs": "rust", ".c": "c", ".cpp": "cpp", ".h": "c", ".swift": "swift", ".dart": "dart", ".txt": "text"}


def _glob(pattern: str) -> str:
    """A glob as a pattern of the path's end: one with a slash starts at the root, ``**`` crosses directories, and one that ends in a slash takes all below."""
    inner = pattern.strip("/")
    out = "".join({"*": "[^/]*", "?": "[^/]", "\0": ".*"}.get(c, re.escape(c)) for c in inner.replace("**", "\0"))
    return ("^" if "/" in inner else "(?:^|/)") + out + ("/" if pattern.endswith("/") else "(?:/|$)")


def drop_ignored(files: DataFrame, globs: tuple[str, ...] = (), binaries: bool = False) -> DataFrame:
    """Files outside of vendored directories (and of build output, unless ``binaries`` are wanted) that match no glob."""
    folders = F.slice(F.split("path", "/"), F.lit(1), F.greatest(F.lit(0), F.size(F.split("path", "/")) - 1))
    keep = ~F.arrays_overlap(folders, F.array(*map(F.lit, VENDOR_DIRS if binaries else VENDOR_DIRS + BUILD_DIRS)))
    for g in (*SKIP_GLOBS, *globs):
        keep &= ~F.col("path").rlike(_glob(g))
    return files.where(F.coalesce(keep, F.lit(True)))


def bound_corpus(files: DataFrame, max_size: int | None = None, fast: bool = False, only_paths: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Files within the size (a fast scan's is ``FAST_BYTES``) and, if given, among ``only_paths``; and one row with how many were ``skipped`` as too large."""
    rows = files if only_paths is None else files.join(only_paths.select("path").distinct(), "path", "left_semi")
    limit = min([x for x in (max_size, FAST_BYTES if fast else None) if x is not None], default=None)
    if limit is None:
        return rows, rows.agg(F.lit(0).cast("long").alias("skipped"))
    return rows.where(F.col("size") <= limit), rows.agg(F.count_if(F.col("size") > limit).alias("skipped"))


def drop_own_outputs(files: DataFrame) -> DataFrame:
    """Files that are no reports of a scanner: no .sarif or .pdf, and no JSON that begins like an inventory or a SARIF log."""
    low, start = F.lower("path"), F.substring("content", 1, 512)
    has = lambda *parts: F.least(*(F.contains(start, F.encode(F.lit(x), "utf-8") if raw else F.lit(x)) for x in parts))
    raw = files.schema["content"].dataType.simpleString() == "binary"
    own = low.endswith(".json") & (has('"bomFormat"', '"CycloneDX"') | has('"$schema"', "sarif"))
    return files.where(~(low.rlike(r"\.(?:sarif|pdf)$") | F.coalesce(own, F.lit(False))))


def text_only(files: DataFrame) -> DataFrame:
    """No NUL in the first 512 bytes, valid UTF-8 there (a character cut at the end doesn't count), no Markdown. Text content is valid."""
    keep = ~F.lower("path").endswith(".md")
    if files.schema["content"].dataType.simpleString() != "binary":
        return files.where(keep & ~F.contains(F.substring("content", 1, 512), F.lit("\0")))
    start = F.substring("content", 1, 512)
    cut = F.length(start) == 512
    valid = _valid(start) | (cut & (_valid(F.substr(start, F.lit(1), F.length(start) - 1)) | _valid(F.substr(start, F.lit(1), F.length(start) - 2)) | _valid(F.substr(start, F.lit(1), F.length(start) - 3))))
    return files.where(keep & ~F.contains(start, F.unhex(F.lit("00"))) & valid)


def _valid(data: Column) -> Column:
    """Whether bytes are valid UTF-8."""
    return F.is_valid_utf8(data.cast("string"))


def language(path: Column) -> Column:
    ext, out = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1), F.lit("other")
    for k, v in LANGUAGES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def explode_lines(files: DataFrame) -> DataFrame:
    """1-based lines; the empty line after a last line end is kept."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).select("path", (F.col("pos") + 1).alias("line"), "text")


def matches(lines: DataFrame, pattern: str, prefilter: Column | None = None) -> DataFrame:
    """Every match of a line with its ordinal there."""
    rows = lines if prefilter is None else lines.where(prefilter)
    return rows.where(F.col("text").rlike(pattern)).select("path", "line", "text", F.posexplode(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))).alias("nth", "token"))


def tokens(lines: DataFrame, pattern: str) -> DataFrame:
    """Every match of a pattern whose matches take whole runs: its place in the line, start column in bytes, and the text on its sides."""
    rows = lines.where(F.col("text").rlike(pattern)).withColumns({"t": F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)), "s": F.split("text", pattern)})
    rows = rows.select("*", F.posexplode("t").alias("nth", "token"))
    bytes_of = lambda c, n: F.aggregate(F.slice(c, F.lit(1), n), F.lit(0), lambda a, x: a + F.octet_length(x))
    before = F.concat(F.when(F.col("nth") > 0, F.get("t", F.col("nth") - 1)).otherwise(F.lit("")), F.get("s", F.col("nth")))
    start = bytes_of("s", F.col("nth") + 1) + bytes_of("t", F.col("nth")) + 1
    return rows.select(*lines.columns, "nth", "token", start.alias("col"), before.alias("before"), F.get("s", F.col("nth") + 1).alias("after"))


def scan_algorithm_names(lines: DataFrame) -> DataFrame:
    """Every algorithm name that stands as a word, with what is known of it."""
    rows = matches(lines, LEFT + "(?:" + "|".join(n[0] for n in ALGORITHM_NAMES) + ")" + RIGHT)
    known = None
    for i, (pattern, name, family, primitive, readiness) in reversed(list(enumerate(ALGORITHM_NAMES))):
        weak = i < WEAK_NAMES
        own = F.struct(*(F.lit(v).alias(k) for k, v in {
            "name": name, "family": family, "primitive": primitive, "quantum_status": readiness, "severity": "medium" if weak else "info", "category": "security" if weak else "inventory",
            "asset_type": "protocol" if primitive == "protocol" else "algorithm", "rule_id": "cbom-regex-algo-" + name.lower().replace(".", "")}.items()))
        hit = F.col("token").rlike(f"^{pattern}$")
        known = F.when(hit, own) if known is None else F.when(hit, own).otherwise(known)
    return rows.select("path", "line", "nth", "token", known.alias("k")).select("path", "line", "nth", "token", "k.*")


def scan_pem_headers(lines: DataFrame) -> DataFrame:
    """First header of each line."""
    kind, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for header, level in reversed(PEM_HEADERS):
        kind, severity = F.when(F.contains("text", F.lit(header)), header.strip("-")[6:]).otherwise(kind), F.when(F.contains("text", F.lit(header)), level).otherwise(severity)
    return lines.where(F.contains("text", F.lit("-----BEGIN "))).select("path", "line", kind.alias("material"), severity.alias("severity")).where("material IS NOT NULL")


def mark_pem_blocks(lines: DataFrame) -> DataFrame:
    """``inside``: the last marker strictly before the line begins a block. A line that does both begins one only
    outside of a block, which no real file has."""
    begins, ends = (F.col("text").rlike(f"-----{x} [A-Z0-9 ]+-----") for x in ("BEGIN", "END"))
    w = W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, -1)
    return lines.withColumn("inside", F.coalesce(F.last(F.when(begins, True).when(ends, False), ignorenulls=True).over(w), F.lit(False)))


def cert_blocks(files: DataFrame) -> DataFrame:
    """One row per PEM certificate with the digest of its DER bytes (null where it doesn't decode)."""
    body = F.regexp_extract_all("content", F.lit(r"(?s)-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----"), F.lit(1))
    der = F.try_to_binary(F.regexp_replace("body", r"\s", ""), F.lit("base64"))
    return files.select("path", F.posexplode(body).alias("nth", "body")).select("path", "nth", F.sha2(der, 256).alias("sha256"))


def _key_lines(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines with a match outside of PEM blocks and commit lines; only these and the markers are sorted."""
    rows = mark_pem_blocks(lines.where(F.col("text").rlike(f"-----(?:BEGIN|END) [A-Z0-9 ]+-----|{pattern}")))
    return rows.where(~F.col("inside") & ~F.contains("text", F.lit("commit ")) & ~F.contains("text", F.lit("Commit:"))).drop("inside")


def scan_hex_keys(lines: DataFrame) -> DataFrame:
    """Runs of 32 or more hex digits; commit lines, PEM blocks, 32 digits beside a hyphen and 40 in a line that speaks
    of a commit don't count. Size is four bits a digit."""
    pattern = "[0-9a-fA-F]{32,}"
    out = tokens(_key_lines(lines, pattern), pattern)
    uuid = (F.length("token") == 32) & (F.endswith("before", F.lit("-")) | F.startswith("after", F.lit("-")))
    commit = (F.length("token") == 40) & F.lower("text").rlike("commit|revision|rev |sha:")
    return out.where(~uuid & ~commit).select("path", "line", "col", "token", (F.length("token") * 4).alias("bits"))


def scan_base64_keys(lines: DataFrame) -> DataFrame:
    """Runs of 40 or more base64 characters; commit lines, PEM blocks, integrity digests and certificates don't count.
    A token of 200 or more is a certificate if it decodes to the start of a DER sequence with a two-byte length, or of a PEM block."""
    pattern = "[A-Za-z0-9+/]{40,}={0,2}"
    out = tokens(_key_lines(lines, pattern), pattern)
    digest = F.lower("before").rlike("sha(?:256|384|512)-$")
    certificate = (F.length("token") >= 200) & (F.startswith("token", F.lit("MII")) | F.startswith("token", F.lit("LS0tLS1CRUdJTiBDRVJUSUZJQ0FURS0tLS0t")))
    return out.where(~digest & ~certificate).select("path", "line", "col", "token")


# Values that are no secret, and what encloses a template.
FLAGS = ("true", "false", "yes", "no", "0", "1", "null", "none", "nil")
PLACEHOLDERS = ("changeme", "change_me", "change-me", "placeholder", "todo", "tbd", "fixme", "xxx", "xxxx", "xxxxx", "secret", "password", "secretkey", "apikey", "token", "example", "sample", "test", "dummy", "fake", "foo", "bar", "baz", "***", "****", "*****", "redacted")
TEMPLATES = (("${", "}"), ("{{", "}}"), ("%", "%"), ("<", ">"), ("[", "]"), ("{", "}"))


def is_boring(value: Column) -> Column:
    """Flags, placeholders, templates and values of fewer than four bytes, in one pair of quotes or none."""
    core = F.regexp_replace(value, r"(?s)^([\"'])(.*)\1$", "$2")
    low = F.lower(core)
    wrapped = F.lit(False)
    for left, right in TEMPLATES:
        wrapped |= core.startswith(left) & core.endswith(right) & (F.length(core) > len(left) + len(right))
    return low.isin(*FLAGS, *PLACEHOLDERS) | wrapped | (low.rlike("^your[_-]") & low.rlike("[_-]here$")) | (F.octet_length(core) < 4)


def scan_assignments(lines: DataFrame, key: str = r"(?i)(?:secret|token|password|passwd|api_?key|private_?key)") -> DataFrame:
    """``name = "value"`` lines whose name looks secret and whose value isn't a placeholder."""
    pattern = rf"({key}[A-Za-z0-9_]*)\s*[=:]\s*[\"']?([^\"'\s]+)"
    rows = lines.where(F.col("text").rlike(pattern)).select("path", "line", F.lower(F.regexp_extract("text", pattern, 1)).alias("key"), F.regexp_extract("text", pattern, 2).alias("value"))
    kind = F.when(F.contains("key", F.lit("pass")), "password").when(F.contains("key", F.lit("token")), "token").when(F.contains("key", F.lit("key")), "key").otherwise("credential")
    return rows.where(~is_boring(F.col("value"))).select("path", "line", "key", "value", kind.alias("material"))


def scan_wrappers(lines: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Calls of stated wrapper functions (wrapper, language, ...) by their full or last name, once per (line, wrapper), in
    files of the wrapper's language: call tokens meet the table in an equi-join."""
    name = r"([A-Za-z_][A-Za-z0-9_]*(?:(?:\.|::)[A-Za-z_][A-Za-z0-9_]*)*)\("
    calls = lines.where(F.contains("text", F.lit("("))).select("path", "line", language(F.col("path")).alias("language"), F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(name), F.lit(1)))).alias("call"))
    last = lambda c: F.regexp_extract(c, r"([A-Za-z0-9_]+)$", 1)
    table = wrappers.withColumn("short", last(F.col("wrapper")))
    rows = calls.withColumn("short", last(F.col("call"))).join(table, ["language", "short"])
    fits = (F.col("call") == F.col("wrapper")) | (F.col("call") == F.col("short")) | F.endswith("call", F.concat(F.lit("."), "wrapper")) | F.endswith("call", F.concat(F.lit("."), "short"))
    return rows.where(fits).drop("short", "call").dropDuplicates(["path", "line", "wrapper"])


#: Calls by language: token, primitive, family, severity. A user's own table has the same columns.
CALLS = (
    ("python", "hashlib.md5", "hash", "md5", "medium"), ("python", "hashlib.sha1", "hash", "sha1", "medium"), ("python", "hashlib.sha256", "hash", "sha256", "info"), ("python", "hashlib.sha512", "hash", "sha512", "info"), ("python", "hashlib.new", "hash", "unknown", "info"),
    ("python", "hashlib.pbkdf2_hmac", "kdf", "pbkdf2", "info"), ("python", "hmac.new", "mac", "hmac", "info"), ("python", "ssl.wrap_socket", "protocol", "tls", "medium"), ("python", "ssl.SSLContext", "protocol", "tls", "info"), ("python", "rsa.generate_private_key", "pke", "rsa", "info"),
    ("python", "ec.generate_private_key", "signature", "ecc", "info"), ("python", "algorithms.AES", "block-cipher", "aes", "info"), ("python", "algorithms.TripleDES", "block-cipher", "3des", "medium"), ("python", "Fernet", "ae", "aes", "info"), ("python", "random.random", "drbg", "weak-random", "info"),
    ("java", "MessageDigest.getInstance", "hash", "unknown", "info"), ("java", "Cipher.getInstance", "cipher", "unknown", "info"), ("java", "KeyPairGenerator.getInstance", "pke", "unknown", "info"), ("java", "KeyGenerator.getInstance", "block-cipher", "unknown", "info"), ("java", "Signature.getInstance", "signature", "unknown", "info"),
    ("java", "Mac.getInstance", "mac", "unknown", "info"), ("java", "SSLContext.getInstance", "protocol", "tls", "info"), ("java", "SecretKeyFactory.getInstance", "kdf", "unknown", "info"),
    ("kotlin", "MessageDigest.getInstance", "hash", "unknown", "info"), ("kotlin", "Cipher.getInstance", "cipher", "unknown", "info"), ("kotlin", "KeyPairGenerator.getInstance", "pke", "unknown", "info"), ("kotlin", "SSLContext.getInstance", "protocol", "tls", "info"),
    ("go", "md5.New", "hash", "md5", "medium"), ("go", "md5.Sum", "hash", "md5", "medium"), ("go", "sha1.New", "hash", "sha1", "medium"), ("go", "sha256.New", "hash", "sha256", "info"), ("go", "sha256.Sum256", "hash", "sha256", "info"), ("go", "sha512.New", "hash", "sha512", "info"),
    ("go", "aes.NewCipher", "block-cipher", "aes", "info"), ("go", "des.NewCipher", "block-cipher", "des", "medium"), ("go", "des.NewTripleDESCipher", "block-cipher", "3des", "medium"), ("go", "rc4.NewCipher", "stream-cipher", "rc4", "medium"), ("go", "rsa.GenerateKey", "pke", "rsa", "info"),
    ("go", "ecdsa.GenerateKey", "signature", "ecdsa", "info"), ("go", "ed25519.GenerateKey", "signature", "ed25519", "info"), ("go", "hmac.New", "mac", "hmac", "info"),
    ("javascript", "crypto.createHash", "hash", "unknown", "info"), ("javascript", "crypto.createCipheriv", "cipher", "unknown", "info"), ("javascript", "crypto.createHmac", "mac", "unknown", "info"), ("javascript", "crypto.generateKeyPair", "pke", "unknown", "info"), ("javascript", "crypto.pbkdf2", "kdf", "pbkdf2", "info"), ("javascript", "jwt.sign", "signature", "unknown", "info"),
    ("typescript", "crypto.createHash", "hash", "unknown", "info"), ("typescript", "crypto.createCipheriv", "cipher", "unknown", "info"), ("typescript", "crypto.createHmac", "mac", "unknown", "info"),
    ("php", "openssl_encrypt", "cipher", "unknown", "info"), ("php", "openssl_pkey_new", "pke", "unknown", "info"), ("php", "md5", "hash", "md5", "medium"), ("php", "sha1", "hash", "sha1", "medium"), ("php", "hash", "hash", "unknown", "info"), ("php", "password_hash", "kdf", "bcrypt", "info"), ("php", "mcrypt_encrypt", "cipher", "unknown", "medium"),
    ("ruby", "OpenSSL::Cipher.new", "cipher", "unknown", "info"), ("ruby", "Digest::MD5.hexdigest", "hash", "md5", "medium"), ("ruby", "Digest::SHA256.hexdigest", "hash", "sha256", "info"), ("ruby", "OpenSSL::PKey::RSA.new", "pke", "rsa", "info"), ("ruby", "BCrypt::Password.create", "kdf", "bcrypt", "info"),
    ("csharp", "MD5.Create", "hash", "md5", "medium"), ("csharp", "SHA1.Create", "hash", "sha1", "medium"), ("csharp", "SHA256.Create", "hash", "sha256", "info"), ("csharp", "Aes.Create", "block-cipher", "aes", "info"), ("csharp", "RSA.Create", "pke", "rsa", "info"), ("csharp", "TripleDES.Create", "block-cipher", "3des", "medium"),
    ("rust", "Sha256::new", "hash", "sha256", "info"), ("rust", "Md5::new", "hash", "md5", "medium"), ("rust", "Aes256Gcm::new", "ae", "aes", "info"), ("rust", "digest::digest", "hash", "unknown", "info"), ("rust", "Rsa::generate", "pke", "rsa", "info"),
    ("c", "EVP_EncryptInit_ex", "cipher", "unknown", "info"), ("c", "MD5_Init", "hash", "md5", "medium"), ("c", "SHA256_Init", "hash", "sha256", "info"), ("c", "RSA_generate_key_ex", "pke", "rsa", "info"), ("c", "AES_set_encrypt_key", "block-cipher", "aes", "info"), ("c", "SSL_CTX_new", "protocol", "tls", "info"),
    ("cpp", "EVP_EncryptInit_ex", "cipher", "unknown", "info"), ("cpp", "MD5_Init", "hash", "md5", "medium"), ("cpp", "SHA256_Init", "hash", "sha256", "info"), ("cpp", "RSA_generate_key_ex", "pke", "rsa", "info"), ("cpp", "SSL_CTX_new", "protocol", "tls", "info"),
    ("swift", "Insecure.MD5.hash", "hash", "md5", "medium"), ("swift", "SHA256.hash", "hash", "sha256", "info"), ("swift", "AES.GCM.seal", "ae", "aes", "info"), ("swift", "CC_MD5", "hash", "md5", "medium"), ("swift", "SecKeyCreateRandomKey", "pke", "unknown", "info"),
    ("dart", "md5.convert", "hash", "md5", "medium"), ("dart", "sha256.convert", "hash", "sha256", "info"), ("dart", "Hmac", "mac", "hmac", "info"), ("dart", "AESEngine", "block-cipher", "aes", "info"),
)


#: Rows of a dictionary at most: it is broadcast.
MAX_CALLS = 50_000


def scan_calls(spark: SparkSession, files: DataFrame, dictionary=CALLS) -> DataFrame:
    """Dotted call tokens outside of comments, joined to a (language, token) dictionary. ``argument`` is the call's first one if it is a
    literal, or a variable to which a literal was last assigned before; ``resolved_family`` is the
    argument's where the dictionary leaves it open."""
    if len(dictionary) > MAX_CALLS:
        raise ValueError(f"a dictionary has {MAX_CALLS} calls at most")
    table = F.broadcast(spark.createDataFrame(list(dictionary), "lang string, token string, primitive string, family string, severity string"))
    lang = language(F.col("path"))
    lines = explode_lines(files.select("path", code.strip_comments(F.col("content"), lang).alias("content"))).withColumn("lang", lang)
    name, value = r"[A-Za-z_][A-Za-z0-9_]*(?:(?:\.|::)[A-Za-z_][A-Za-z0-9_]*)*", r"[\"'][^\"'\n]*[\"']|\$?[A-Za-z_][A-Za-z0-9_]*(?=\s*[,)])"
    calls = lines.where(F.contains("text", F.lit("("))).select("path", "line", "lang", F.explode(F.regexp_extract_all("text", F.lit(rf"({name}\((?:\s*(?:{value}))?)"), F.lit(1))).alias("call"))
    calls = calls.select("path", "line", "lang", F.substring_index("call", "(", 1).alias("token"), F.trim(F.regexp_extract("call", r"\((.*)$", 1)).alias("given")).join(table, ["lang", "token"])
    literal = F.col("given").rlike("^[\"']")
    known = code.assignments(lines)
    open_ = calls.where(~literal & (F.col("given") != ""))
    met = code.as_of(known, open_.withColumns({"name": F.ltrim(F.col("given"), F.lit("$")), "line": F.col("line") + 1})).withColumn("line", F.col("line") - 1).drop("name")
    own = calls.where(literal | (F.col("given") == "")).withColumn("value", F.when(literal, F.substring("given", 2, F.length("given") - 2)))
    rows = own.unionByName(met).withColumn("argument", F.coalesce("value", F.lit("")))
    family = F.when((F.col("family") == "unknown") & (F.col("argument") != ""), algorithm_family(F.col("argument"), table=FAMILY_FULL)).otherwise(F.col("family"))
    return rows.select("path", "line", "lang", "argument", "token", "primitive", "family", "severity", family.alias("resolved_family"))


def split_cipher_spec(spec: Column) -> Column:
    """ALG/MODE/PADDING as a struct with flags for ECB and PKCS1."""
    part = F.split(spec, "/")
    return F.struct(F.get(part, F.lit(0)).alias("algorithm"), F.get(part, F.lit(1)).alias("mode"), F.get(part, F.lit(2)).alias("padding"), (F.upper(F.get(part, F.lit(1))) == "ECB").alias("ecb"), F.contains(F.upper(F.get(part, F.lit(2))), F.lit("PKCS1")).alias("pkcs1"))


def propagate_constants(lines: DataFrame) -> DataFrame:
    """Last literal assigned to each variable of a file."""
    pattern = r"^\s*(?:const |final |let |var )?([A-Za-z_][A-Za-z0-9_]*)\s*:?=\s*[\"']([^\"']*)[\"']"
    rows = lines.where(F.col("text").rlike(pattern)).select("path", "line", F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("value"))
    return rows.groupBy("path", "name").agg(F.max_by("value", "line").alias("value"))


# Weak cipher names.
WEAK_CIPHERS = ("RC4", "RC4-SHA", "RC4-MD5", "DES", "DES-CBC-SHA", "DES-CBC3-SHA", "3DES", "NULL", "NULL-SHA", "NULL-MD5", "EXP", "EXPORT", "EXPORT40", "EXPORT56", "aNULL", "eNULL", "SEED", "IDEA", "MD5")


def scan_tls_config(lines: DataFrame) -> DataFrame:
    """Protocols and weak ciphers switched on in server configurations (``ssl_protocols``, ``SSLProtocol``, ``ssl_ciphers``, ``SSLCipherSuite``)."""
    low = F.lower(F.trim("text"))
    protocols = lines.where(low.rlike(r"^(ssl_protocols|sslprotocol)\s")).select("path", "line", F.explode(F.split(F.regexp_replace(F.trim("text"), r"(?i)^\S+\s+|;$", ""), r"\s+")).alias("token"))
    protocols = protocols.where(~F.startswith("token", F.lit("-"))).withColumn("token", F.regexp_replace("token", r"^\+", ""))
    level = F.when(F.upper("token").isin("SSLV2", "SSLV3"), "critical").when(F.upper("token").isin("TLSV1", "TLSV1.0", "TLSV1.1"), "high").otherwise("info")
    ciphers = lines.where(low.rlike(r"^(ssl_ciphers|sslciphersuite)\s")).select("path", "line", F.explode(F.split(F.regexp_replace(F.trim("text"), r"(?i)^\S+\s+|[\"';]", ""), ":")).alias("token"))
    bad = ciphers.where(F.col("token").isin(*WEAK_CIPHERS))
    return protocols.select("path", "line", "token", level.alias("severity")).unionByName(bad.select("path", "line", "token", F.lit("high").alias("severity")))


def logical_lines(lines: DataFrame) -> DataFrame:
    """Lines joined where the one before ends in a backslash."""
    w = W.partitionBy("path").orderBy("line")
    marked = lines.withColumn("starts", F.when(F.lag(F.endswith("text", F.lit("\\"))).over(w), 0).otherwise(1))
    numbered = marked.withColumn("logical", F.sum("starts").over(w.rowsBetween(W.unboundedPreceding, 0)))
    parts = numbered.groupBy("path", "logical").agg(F.min("line").alias("line"), F.array_sort(F.collect_list(F.struct("line", F.regexp_replace("text", r"\\$", "").alias("text")))).alias("p"))
    return parts.select("path", "line", F.array_join(F.transform("p", lambda x: x.text), "").alias("text"))


def check_kdf(calls: DataFrame) -> DataFrame:
    """PBKDF2 under 100000 rounds and bcrypt under cost 10; unknown values aren't judged."""
    n = F.expr("try_cast(rounds AS INT)")
    weak = ((F.col("kdf") == "pbkdf2") & (n > 0) & (n < 100_000)) | ((F.col("kdf") == "bcrypt") & (n > 0) & (n < 10))
    return calls.where(weak).withColumn("severity", F.lit("medium"))


def fingerprint(rule: Column, path: Column, snippet: Column) -> Column:
    """sha256 of rule, file and the snippet without comments, literals and spacing."""
    text = F.regexp_replace(snippet, r"(?s)/\*.*?\*/", "")
    text = F.regexp_replace(text, r"(?://|#)[^\n]*", "")
    text = F.regexp_replace(text, r"\"[^\"]*\"|'[^']*'", "STR")
    text = F.regexp_replace(text, r"(?<![A-Za-z0-9_])[0-9]+(?![A-Za-z0-9_])", "NUM")
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.sha2(F.concat_ws(":", rule, path, text), 256)


def library_banners(files: DataFrame) -> DataFrame:
    """One row per file and library whose version banner is in it; binary content is read as ISO-8859-1."""
    raw = files.schema["content"].dataType.simpleString() == "binary"
    content = F.decode("content", "ISO-8859-1") if raw else F.col("content")
    hits = []
    for library, (package, banner) in LIBRARY_BANNERS.items():
        version = F.regexp_extract(content, banner, 1) if "(" in banner else F.lit("")
        purl = F.when(version == "", "").otherwise(F.concat(F.lit(f"pkg:generic/{package}@"), version))
        hits.append(F.when(content.rlike(banner), F.struct(F.lit(library).alias("library"), version.alias("version"), purl.alias("purl"), F.lit(f"cbom-binary-lib-{package}").alias("rule_id"))))
    return files.select("path", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("path", "hit.*")


def dockerfile_findings(files: DataFrame) -> DataFrame:
    """Unpinned installs of OpenSSL, installs of its libraries and exposed TLS ports, in files named as image recipes."""
    base = F.lower(F.substring_index("path", "/", -1))
    lines = explode_lines(files.where((base == "dockerfile") | base.startswith("dockerfile.") | base.endswith(".dockerfile")))
    lines = lines.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> '' AND text NOT LIKE '#%'")
    has = lambda pattern, right=RIGHT: F.col("text").rlike(f"(?i){LEFT}{pattern}{right}")
    installs = F.upper("text").startswith("RUN") & has(INSTALL)
    said = lambda rule, name: F.struct(F.lit(f"cbom-configfile-dockerfile-{rule}").alias("rule_id"), name.alias("name"))
    ports = F.filter(F.transform(F.slice(F.split("text", r"\s+"), 2, 1 << 30), lambda p: F.substring_index(p, "/", 1)), lambda p: p.isin(*TLS_PORTS))
    ports = F.when(F.upper("text").startswith("EXPOSE"), F.transform(ports, lambda p: said("tls-port", F.concat(F.lit("TLS endpoint: EXPOSE "), p)))).otherwise(F.array())
    single = F.array_compact(F.array(
        F.when(installs & has(OPENSSL) & ~has(PINNED, ""), said("unpinned-openssl", F.lit("Unpinned OpenSSL install"))),
        F.when(installs & has(CRYPTO_PACKAGES), said("unpinned-crypto-lib", F.lit("Unpinned crypto library install")))))
    return lines.select("path", "line", F.inline(F.concat(single, ports)))


def java_security_findings(files: DataFrame) -> DataFrame:
    """Weak algorithms that ``*.security`` files don't disable (a name within another counts as disabled), key managers and key stores.

    Lines that end in a backslash go on in the next one; line numbers are those of the joined lines.
    """
    own = files.where(F.lower("path").endswith(".security"))
    lines = explode_lines(own.select("path", F.regexp_replace("content", r"\\[ \t]*(?:\n|\z)", "").alias("content")))
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    part = lambda k: F.regexp_extract("text", r"(?s)^([^=]*?)\s*=\s*(.*)$", k)
    rows = lines.withColumn("text", text).where("text LIKE '%=%' AND NOT text RLIKE '^[#!]'").select("path", "line", part(1).alias("key"), F.lower(part(2)).alias("value"))
    said = lambda rule, name, severity: F.struct(F.lit(f"cbom-configfile-java-{rule}").alias("rule_id"), name.alias("name"), F.lit(severity).alias("severity"))
    tls, path = F.col("key") == "jdk.tls.disabledAlgorithms", F.col("key") == "jdk.certpath.disabledAlgorithms"
    hits = [F.when(when & ~F.col("value").contains(name.lower()), said("missing-disabled-algo", F.lit(f"Missing disabled algorithm: {name}"), severity))
            for when, weak in ((tls | path, JAVA_WEAK), (tls, JAVA_WEAK_TLS)) for name, severity in weak.items()]
    for rule, keys, known in (("keymanager-algorithm", ("ssl.KeyManagerFactory.algorithm", "ssl.TrustManagerFactory.algorithm"), KEY_MANAGERS), ("keystore-type", ("keystore.type",), KEY_STORES)):
        hits.append(F.when(F.col("key").isin(*keys) & F.col("value").isin(*known), said(rule, lookup(F.col("value"), known), "info")))
    return rows.select("path", "line", F.inline(F.array_compact(F.array(*hits))))
