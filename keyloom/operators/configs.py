"""Scans of configuration files: environments, properties, OpenSSL and Kubernetes. Frames have ``path`` and ``content``;
all give (path, line, rule_id, name, severity, detail) rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.crypto import lookup
from keyloom.operators.detect import WEAK_CIPHERS, explode_lines, is_boring

#: A word boundary between ASCII characters, as in the patterns' own dialect.
_B = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"

# What names of secrets hold, protocol versions and algorithms in values.
ENV_SECRET = r"(?i)^([^#\s][^=]*?(?:secret|key|password|token|api_key|apikey|auth|credential|private)[^=]*)=(.+)$"
INDICATORS = "secret|key|password|token|auth|credential|private"
TLS_VERSION = rf"(?i){_B}(TLSv1\.?[012]?|SSLv[23]){_B}"
ALGORITHM = rf"(?i){_B}(AES|RSA|MD5|SHA|DES|3DES|RC4|Blowfish){_B}"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _lines(files: DataFrame, comments: str) -> DataFrame:
    """Trimmed lines that are neither empty nor comments."""
    rows = explode_lines(files).withColumn("text", _trim(F.col("text")))
    return rows.where((F.col("text") != "") & ~F.col("text").rlike(f"^[{comments}]"))


def _hit(rule: str, name: Column, severity: Column | str, detail: Column | None = None) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit(f"cbom-config{rule}").alias("rule_id"), name.alias("name"), level.alias("severity"), (F.lit(None).cast("string") if detail is None else detail).alias("detail"))


def _rows(lines: DataFrame, *hits: Column) -> DataFrame:
    return lines.select("path", "line", F.inline(F.array_compact(F.array(*hits))))


def scan_env(files: DataFrame) -> DataFrame:
    """Secrets in ``.env`` files: a name that speaks of one and a value that is none of the usual fillers."""
    lines = _lines(files.where(F.col("path").endswith(".env")), "#")
    key, value = (_trim(F.regexp_extract("text", ENV_SECRET, i)) for i in (1, 2))
    low = F.lower(key)
    kind = F.when(low.contains("key"), "secret-key").when(low.contains("token"), "token").when(low.contains("credential"), "credential").otherwise("password")
    secret = F.col("text").rlike(ENV_SECRET) & (value != "") & ~is_boring(value)
    return _rows(lines, F.when(secret, _hit("-hardcoded-secret", F.concat(F.lit("Hardcoded secret: "), key), "high", kind)))


def scan_properties(files: DataFrame) -> DataFrame:
    """Secrets, protocol versions and algorithm names in ``.properties`` files; the name ends at the first ``=`` or ``:``."""
    split = r"(?s)^([^=:]*)[=:](.*)$"
    lines = _lines(files.where(F.col("path").endswith(".properties")), "#!").where(F.col("text").rlike(split))
    key, value = (_trim(F.regexp_extract("text", split, i)) for i in (1, 2))
    lines = lines.select("path", "line", key.alias("key"), value.alias("value"))
    low, value = F.lower("key"), F.col("value")
    kind = F.when(low.contains("key"), "secret-key").when(low.contains("secret"), "password").when(low.contains("token"), "token").otherwise("password")
    speaks = low.rlike(INDICATORS)
    version, algorithm = F.regexp_extract(value, TLS_VERSION, 1), F.regexp_extract(value, ALGORITHM, 1)
    return _rows(lines, F.when(speaks & (value != "") & ~is_boring(value), _hit("-hardcoded-secret", F.concat(F.lit("Hardcoded secret: "), "key"), "high", kind)),
                 F.when(version != "", _hit("-tls-version", F.concat(F.lit("TLS/SSL version: "), version), "medium", version)),
                 F.when(~speaks & (algorithm != ""), _hit("-algorithm-ref", F.concat(F.lit("Algorithm reference: "), algorithm), "info", F.lower(algorithm))))


def scan_openssl(files: DataFrame) -> DataFrame:
    """Weak digests and key sizes in ``openssl.cnf`` files."""
    base = F.lower(F.substring_index("path", "/", -1))
    lines = _lines(files.where(base == "openssl.cnf"), "#\\[").where("text LIKE '%=%'")
    key, value = F.lower(_trim(F.substring_index("text", "=", 1))), _trim(F.regexp_extract("text", "(?s)^[^=]*=(.*)$", 1))
    bits = F.when(value.rlike(r"^[+-]?\d{1,9}$"), value).cast("int")
    digest = F.when(F.lower(value) == "md5", "MD5").when(F.lower(value).isin("sha1", "sha-1"), "SHA-1")
    return _rows(lines, F.when((key == "default_md") & digest.isNotNull(), _hit("file-openssl-weak-digest", F.concat(F.lit("Weak digest: "), digest), "high")),
                 F.when((key == "default_bits") & (bits < 2048), _hit("file-openssl-weak-keysize", F.concat(F.lit("Weak key size: "), bits.cast("string"), F.lit(" bits")), F.when(bits <= 1024, "critical").otherwise("high"))))


def scan_kubernetes(files: DataFrame) -> DataFrame:
    """TLS secrets, weak ciphers and protocols of annotations, and certificate data, in YAML files that hold both ``apiVersion:`` and ``kind:``.
    Certificate data counts if it decodes; its digest is the detail (its fields are not parsed)."""
    own = files.where(F.lower("path").rlike(r"\.ya?ml$") & F.contains("content", F.lit("apiVersion:")) & F.contains("content", F.lit("kind:")))
    lines = _lines(own, "#")
    text, has = F.col("text"), lambda part: F.contains("text", F.lit(part))
    secret = _trim(F.regexp_replace("text", "^secretName:", ""))
    value = F.regexp_replace(_trim(F.regexp_extract("text", "(?s)^[^:]*:(.*)$", 1)), "^[\"']+|[\"']+$", "")
    tokens = lambda pattern: F.transform(F.split(value, pattern), _trim)
    weak = F.filter(tokens(":"), lambda c: c.isin(*WEAK_CIPHERS))
    old = F.filter(tokens(r"\s+"), lambda p: F.lower(p).isin("tlsv1", "tlsv1.0", "tlsv1.1"))
    none = F.array().cast("array<struct<rule_id:string,name:string,severity:string,detail:string>>")
    each = lambda when, found, rule, name: F.when(when, F.transform(found, lambda x: _hit(f"file-k8s-{rule}", F.concat(F.lit(name), x), "high", x))).otherwise(none)
    data = r"^([A-Za-z0-9_.-]+\.(?:crt|cer|pem)):\s+([A-Za-z0-9+/=]{40,})$"
    der = F.try_to_binary(F.regexp_extract("text", data, 2), F.lit("base64"))
    single = F.array_compact(F.array(
        F.when(has("kubernetes.io/tls"), _hit("file-k8s-tls-secret", F.lit("Kubernetes TLS secret"), "info")),
        F.when(has("secretName:"), _hit("file-k8s-ingress-tls", F.concat(F.lit("Ingress TLS secret: "), secret), "info")),
        F.when(text.rlike(data) & der.isNotNull(), _hit("file-k8s-cert", F.concat(F.regexp_extract("text", data, 1), F.lit(" (k8s secret data)")), "info", F.sha2(der, 256)))))
    return lines.select("path", "line", F.inline(F.concat(single, each(has("ssl-ciphers"), weak, "weak-cipher", "Weak cipher in K8s annotation: "), each(has("ssl-protocols"), old, "weak-protocol", "Weak TLS protocol in K8s annotation: "))))


# What tells the configuration of one server from the other's; both are looked for in a file.
NGINX_MARKS = ("server {", "server{", "ssl_protocols", "ssl_ciphers", "ssl_certificate", "proxy_pass", "location", "upstream", "nginx")
HTTPD_MARKS = ("SSLProtocol", "SSLCipherSuite", "SSLEngine", "SSLCertificateFile", "<VirtualHost", "ServerRoot", "LoadModule", "ServerName")


def scan_server_config(files: DataFrame) -> DataFrame:
    """Weak protocols, weak ciphers, and paths of certificates and keys in ``.conf`` files that hold a server's marks. Comment
    lines say nothing; ciphers behind ``!`` are switched off; other protocols are no finding."""
    holds = lambda marks: reduce(or_, (F.contains("content", F.lit(m)) for m in marks))
    own = files.where(F.lower("path").endswith(".conf")).select("path", "content", holds(NGINX_MARKS).alias("nginx"), holds(HTTPD_MARKS).alias("httpd")).where("nginx OR httpd")
    lines = own.select("path", "nginx", "httpd", F.posexplode(F.split("content", "\n")).alias("pos", "text")).withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> '' AND NOT text LIKE '#%'")
    value = lambda directive: F.trim(F.regexp_replace(F.expr(f"substring(text, {len(directive) + 1})"), r"^\s+|\s+$", ""))
    bare = lambda c: F.regexp_replace(c, ";$", "")
    said = lambda rule, name, severity, detail: F.struct(F.lit(f"cbom-configfile-{rule}").alias("rule_id"), name.alias("name"), severity.alias("severity"), detail.alias("detail"))

    def directive(server: str, name: str, found: Column) -> Column:
        return F.when(F.col(server) & F.startswith("text", F.lit(name)), found).otherwise(F.array().cast("array<struct<rule_id:string,name:string,severity:string,detail:string>>"))

    def protocols(server: str, tokens: Column) -> Column:
        broken, weak = ("sslv2", "sslv3"), ("tlsv1", "tlsv1.1") if server == "httpd" else ("tlsv1", "tlsv1.0", "tlsv1.1")
        canonical = (lambda t: lookup(F.lower(t), {"sslv2": "SSLv2", "sslv3": "SSLv3", "tlsv1": "TLSv1", "tlsv1.1": "TLSv1.1"}, "")) if server == "httpd" else (lambda t: t)
        bad = F.filter(tokens, lambda t: F.lower(t).isin(*broken, *weak))
        return F.transform(bad, lambda t: said(f"{server}-weak-protocol", F.concat(F.when(F.lower(t).isin(*broken), "Insecure protocol: ").otherwise("Weak TLS protocol: "), canonical(t)), F.when(F.lower(t).isin(*broken), "critical").otherwise("high"), canonical(t)))

    def ciphers(server: str, text: Column) -> Column:
        bad = F.filter(F.transform(F.split(text, ":"), lambda c: F.trim(c)), lambda c: c.isin(*WEAK_CIPHERS))
        return F.transform(bad, lambda c: said(f"{server}-weak-cipher", F.concat(F.lit("Weak cipher: "), c), F.lit("high"), c))

    quoted = F.regexp_replace(bare(value("ssl_ciphers")), "^[\"']+|[\"']+$", "")
    signed = F.transform(F.split(value("SSLProtocol"), r"\s+"), lambda t: F.regexp_replace(t, r"^\+", ""))
    key = F.startswith("text", F.lit("ssl_certificate_key"))
    paths = F.when(key, F.array(said("nginx-private-key", F.concat(F.lit("TLS private key: "), bare(value("ssl_certificate_key"))), F.lit("info"), bare(value("ssl_certificate_key"))))).otherwise(
        F.array(said("nginx-certificate", F.concat(F.lit("TLS certificate: "), bare(value("ssl_certificate"))), F.lit("info"), bare(value("ssl_certificate")))))
    hits = F.concat(
        directive("nginx", "ssl_protocols", protocols("nginx", F.transform(F.split(value("ssl_protocols"), r"\s+"), bare))), directive("nginx", "ssl_ciphers", ciphers("nginx", quoted)), directive("nginx", "ssl_certificate", paths),
        directive("httpd", "SSLProtocol", protocols("httpd", signed)), directive("httpd", "SSLCipherSuite", ciphers("httpd", value("SSLCipherSuite"))))
    return lines.select("path", (F.col("pos") + 1).alias("line"), F.inline(hits))
