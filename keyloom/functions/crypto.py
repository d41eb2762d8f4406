"""Scalar vocabulary of crypto findings as column expressions: families, posture, ranks and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keyword contained in the lower-cased name -> family; the first one that fits wins.
FAMILY_FULL = (
    ("sha3-512", "sha3-512"), ("sha3-384", "sha3-384"), ("sha3-256", "sha3-256"), ("sha-512", "sha512"), ("sha512", "sha512"),
    ("sha-384", "sha384"), ("sha384", "sha384"), ("sha-256", "sha256"), ("sha256", "sha256"), ("sha-3", "sha3-256"), ("sha3", "sha3-256"),
    ("sha-1", "sha1"), ("sha1", "sha1"), ("md5", "md5"), ("md4", "md4"), ("3des", "3des"), ("triple-des", "3des"), ("triple des", "3des"),
    ("tripledes", "3des"), ("des-ede", "3des"), ("des", "des"), ("rc4", "rc4"), ("aes", "aes"), ("blowfish", "blowfish"),
    ("chacha20", "chacha20"), ("ml-kem", "ml-kem"), ("kyber", "ml-kem"), ("ml-dsa", "ml-dsa"), ("dilithium", "ml-dsa"), ("slh-dsa", "slh-dsa"),
    ("sphincs", "slh-dsa"), ("ecdsa", "ecdsa"), ("ecdh", "ecdh"), ("ecc", "ecc"), ("rsa", "rsa"), ("dsa", "dsa"), ("diffie-hellman", "dh"),
    ("dh", "dh"), ("hmac-drbg", "hmac-drbg"), ("hash-drbg", "hash-drbg"), ("ctr-drbg", "ctr-drbg"), ("math.random", "math-random"),
    ("math_random", "math-random"), ("rand()", "rand"),
)
FAMILY_LITE = (
    ("sha3-512", "sha3-512"), ("sha3-384", "sha3-384"), ("sha3-256", "sha3-256"), ("sha-256", "sha256"), ("sha256", "sha256"),
    ("sha-512", "sha512"), ("sha512", "sha512"), ("md5", "md5"), ("md4", "md4"), ("3des", "3des"), ("des", "des"), ("rc4", "rc4"), ("aes", "aes"),
    ("ml-kem", "ml-kem"), ("ml-dsa", "ml-dsa"), ("slh-dsa", "slh-dsa"), ("ecdsa", "ecdsa"), ("ecdh", "ecdh"), ("ecc", "ecc"), ("rsa", "rsa"),
    ("dsa", "dsa"), ("dh", "dh"),
)
# Families by posture, their replacements, weights and ranks.
BROKEN = ("des", "3des", "rc4", "md5", "md4")
VULNERABLE = ("rsa", "ecdsa", "ecdh", "ecc", "dh", "dsa")
SAFE = ("aes", "sha256", "sha384", "sha512", "sha3-256", "sha3-384", "sha3-512", "ml-kem", "ml-dsa", "slh-dsa")
MIGRATION = {"rsa": "ml-dsa", "ecdsa": "ml-dsa", "ecdh": "ml-kem", "ecc": "ml-kem", "dh": "ml-kem", "dsa": "ml-dsa"}
SEVERITY_WEIGHT = {"critical": 10.0, "high": 7.0, "medium": 4.0, "low": 1.0, "info": 0.0}
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}


def lookup(col: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table, as a chain of conditions."""
    out = F.lit(default)
    for k, v in reversed(list(table.items())):
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once. A column that stands in every branch of a chain of conditions is otherwise computed in each of
    them, and so are all that it is made of, above all in filters, which Spark moves down to the table."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def algorithm_family(name: Column, explicit: Column | None = None, table=FAMILY_FULL) -> Column:
    """Explicit family if given, else that of the first keyword in the lower-cased name, else ``unknown``."""

    def first(low: Column) -> Column:
        out = F.lit("unknown")
        for keyword, family in reversed(table):
            out = F.when(low.contains(keyword), family).otherwise(out)
        return out

    out = once(F.lower(F.coalesce(name, F.lit(""))), first)
    return out if explicit is None else F.coalesce(F.nullif(F.lower(F.trim(explicit)), F.lit("")), out)


def posture(family: Column) -> Column:
    """broken, vulnerable, safe or unknown."""
    return once(family, lambda f: F.when(f.isin(*BROKEN), "broken").when(f.isin(*VULNERABLE), "vulnerable").when(f.isin(*SAFE), "safe").otherwise("unknown"))


def posture_severity(state: Column) -> Column:
    return F.when(state == "broken", "critical").when(state == "vulnerable", "medium").otherwise("info")


def severity_rank(severity: Column) -> Column:
    return lookup(F.lower(severity), SEVERITY_RANK, 0)


def severity_weight(severity: Column, default: float = 4.0) -> Column:
    return lookup(F.lower(severity), SEVERITY_WEIGHT, default)


def quantum_priority(status: Column, primitive: Column) -> Column:
    """critical for broken; by primitive for vulnerable ones; none for safe; else null."""
    vulnerable = status.isin("vulnerable", "quantum-vulnerable")
    return (F.when(status == "broken", "critical").when(vulnerable & primitive.isin("pke", "key-agree", "kem"), "critical")
            .when(vulnerable & (primitive == "signature"), "high").when(vulnerable, "medium").when(status.isin("safe", "quantum-safe"), "none"))


def engine_severity(level: Column) -> Column:
    return lookup(F.upper(F.trim(level)), {"ERROR": "high", "WARNING": "medium"}, "info")


def clean_rule_id(rule_id: Column) -> Column:
    return F.substring_index(rule_id, ".", -1)


def display_name(rule_id: Column, languages: str = "python|java|go|javascript|kotlin|csharp|php|ruby|rust|cpp|swift|dart") -> Column:
    return F.regexp_replace(clean_rule_id(rule_id), f"^cbom-(?:{languages})-", "")


def protocol_type(name: Column) -> Column:
    """A protocol's type in the document format; an empty name stays empty."""
    # The types that the format knows.
    low = F.lower(F.trim(name))
    return F.when((name == "") | (low == ""), "").when(low == "ssl", "tls").when(low.isin("tls", "ssh", "ipsec", "ike", "sstp", "wpa", "dtls", "quic", "eap-aka", "eap-aka-prime", "prins", "5g-aka", "other", "unknown"), low).otherwise("other")


def sarif_level(severity: Column) -> Column:
    return lookup(severity, {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}, "none")


def effort_minutes(severity: Column) -> Column:
    return lookup(severity, {"critical": 60, "high": 30, "medium": 15}, 5)


def key_size_band(size: Column) -> Column:
    return F.when(size.isNull(), "unknown").when(size < 2048, "weak").when(size < 3072, "legacy").otherwise("strong")


def relative_time(seconds: Column) -> Column:
    """Elapsed whole seconds as ``Ns/m/h/d ago``."""
    part = lambda n, unit: F.concat(F.floor(seconds / n).cast("string"), F.lit(unit))
    return F.when(seconds < 60, part(1, "s ago")).when(seconds < 3600, part(60, "m ago")).when(seconds < 86400, part(3600, "h ago")).otherwise(part(86400, "d ago"))


def mean_score(score: Column) -> Column:
    """Mean of scores with one decimal. Tenths are summed as integers, so that the mean does not depend on their order."""
    return F.try_divide(F.sum(F.round(score * 10).cast("long")).cast("double"), F.count(score) * F.lit(10.0))


def rounded_percent(part: Column, whole: Column, places: int = 1, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(F.bround(F.try_divide(part * 100.0, whole), places))
