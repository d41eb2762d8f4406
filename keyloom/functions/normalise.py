"""Normalisation of findings as column expressions: categories, key sizes, primitives, quantum readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.crypto import lookup

#: Word ends in ASCII, as in the patterns' own dialect.
_LEFT, _RIGHT = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"

# Parts of rule ids that tell the category. Tokens of broken algorithms count before a hyphen or at the end.
SECURITY_TOKENS = ("-weak", "-broken", "-insecure", "-hardcoded", "-disabled", "-deprecated", "-ecb", "-pkcs1v15", "-no-padding", "-nopadding", "-low-iter", "-low-entropy", "-expired", "-self-signed", "-cert-none", "-no-verify", "-noverify",
                   "-padding-oracle", "-downgrade", "-anonymous", "-null-cipher", "-export-cipher", "-static-iv", "-zero-iv", "-fixed-iv", "-reused-", "-cbc-without-mac", "-mac-then-encrypt", "-as-password")
BROKEN_TOKENS = ("-md5", "-md4", "-md2", "-sha-1", "-sha1", "-rc4", "-rc2", "-3des", "-tripledes", "-sslv3", "-sslv2", "-tlsv10", "-tlsv11", "-tls-10", "-tls-11", "-mcrypt")
INVENTORY_TOKENS = ("-import", "-imports", "-found", "-asset", "-detect", "-library", "-package", "-pem-", "-cipher-suite", "-keysize", "-curve", "-certificate-parsed")
NOISY_RULES = ("cbom-regex-hex-key", "cbom-regex-base64-key")
# Families whose names carry a key size, and the sizes that count as one.
SIZED = ("aes", "rsa", "camellia", "aria", "blowfish", "rc2", "rc4", "rc5", "des", "3des", "dh", "dsa", "rsaes", "rsassa")
SIZES = (56, 64, 80, 112, 128, 160, 168, 192, 224, 256, 384, 512, 521, 1024, 2048, 3072, 4096, 8192)
CURVES = {"secp256r1": 256, "secp384r1": 384, "secp521r1": 521, "secp256k1": 256, "prime256v1": 256, "curve25519": 256, "x25519": 256, "ed25519": 256, "x448": 448}
# What a primitive's name may begin with, and block cipher modes.
PRIMITIVES = ("MD", "SHA", "SHAKE", "AES", "DES", "3DES", "RC", "RSA", "DSA", "DH", "ECDH", "ECDSA", "ED", "X25519", "X448", "CURVE", "SECP", "BLOWFISH", "CAMELLIA", "CAST", "IDEA", "SEED", "SERPENT", "SM3", "SM4", "TWOFISH", "ARIA", "CHACHA", "XSALSA",
              "POLY1305", "BLAKE", "RIPEMD", "TIGER", "WHIRLPOOL", "KECCAK", "GOST", "SKEIN", "SM2", "ECIES", "IES", "PBKDF", "HKDF", "SCRYPT", "BCRYPT", "ARGON", "HMAC", "GMAC", "CMAC", "TLS", "SSL", "SSH", "IPSEC", "DTLS", "KYBER", "ML-KEM", "ML-DSA",
              "DILITHIUM", "FALCON", "SPHINCS", "XMSS", "LMS", "HSS", "NTRU", "HQC", "PKCS", "OAEP", "FERNET", "CRYPTO-LIBRARY-IMPORT", "OPENSSL", "LIBSODIUM", "BORINGSSL", "MBEDTLS", "WOLFSSL", "GNUTLS", "NSS", "X.509")
MODES = ("ECB", "CBC", "GCM", "CTR", "CFB", "OFB", "CCM", "XTS", "SIV", "KW")
# Tokens that are no algorithm, by the asset type they belong to.
MARKERS = {
    "related-crypto-material": ("HARDCODED-SECRET", "HARDCODE-SECRET", "HARDCODED_SECRET", "PRIVATE-KEY-PEM", "PRIVATE-KEY", "PRIVATE_KEY", "PUBLIC-KEY-PEM", "PUBLIC-KEY", "PUBLIC_KEY", "INITIALIZATION-VECTOR", "IV", "SYMMETRIC-KEY", "SHARED-SECRET", "NONCE", "SALT", "SEED", "PASSWORD", "CREDENTIAL", "TOKEN"),
    "protocol": ("SSH", "TLS", "TLS-1.0", "TLS-1.1", "TLS-1.2", "TLS-1.3", "SSL", "SSL-2.0", "SSL-3.0", "DTLS", "DTLS-1.0", "DTLS-1.2", "DTLS-1.3", "IPSEC", "IKE", "IKEV1", "IKEV2", "SAML", "OIDC", "JWT"),
    "certificate": ("CERTIFICATE", "CERTIFICATE-X509", "X509", "X.509"),
}
# Named curves and the family they stand for; asset types that have no readiness.
CURVE_FAMILIES = {**dict.fromkeys(("P-192", "P-224", "P-256", "P-384", "P-521", "SECP192R1", "SECP224R1", "SECP256R1", "SECP256K1", "SECP384R1", "SECP521R1", "BRAINPOOLP256R1", "BRAINPOOLP384R1", "BRAINPOOLP512R1"), "ec"),
                  **dict.fromkeys(("CURVE25519", "ED25519PH", "ED25519CTX"), "ed25519"), "CURVE448": "ed448"}
NOT_ALGORITHMS = ("related-crypto-material", "certificate", "library")
PQC_PREFIXES = ("ML-KEM-", "ML-DSA-", "SLH-DSA-", "KYBER-", "DILITHIUM-", "FALCON-", "SPHINCS-")
# Family, quantum readiness, NIST level, other names.
QUANTUM = """
rsa quantum-vulnerable 0 rsa-pss rsa-oaep rsaes-pkcs1 rsassa-pkcs1 rsassa-pss
dsa quantum-vulnerable 0
dh quantum-vulnerable 0 ffdh diffie-hellman
ecdsa quantum-vulnerable 0
ecdh quantum-vulnerable 0
ec quantum-vulnerable 0
ed25519 quantum-vulnerable 0
ed448 quantum-vulnerable 0
x25519 quantum-vulnerable 0
x448 quantum-vulnerable 0
elgamal quantum-vulnerable 0
ecies quantum-vulnerable 0
sm2 quantum-vulnerable 0
gost quantum-vulnerable 0
schnorr quantum-vulnerable 0 bip340 bip-340 schnorrkel
bls quantum-vulnerable 0 bls12-381 bls12381 bls-signature boneh-lynn-shacham
ecmqv quantum-vulnerable 0 mqv
paillier quantum-vulnerable 0
rabin quantum-vulnerable 0
ec-gdsa quantum-vulnerable 0 ecgdsa
ec-kcdsa quantum-vulnerable 0 eckcdsa
aes quantum-safe 1 aes-128 aes-192 aes-256
chacha20 quantum-safe 1 chacha xchacha20
camellia quantum-safe 1
aria quantum-safe 1
seed quantum-safe 1
sm4 quantum-safe 1
salsa20 quantum-safe 1 xsalsa20
serpent quantum-safe 1
twofish quantum-safe 1
sha-256 quantum-safe 1 sha256
sha-384 quantum-safe 3 sha384
sha-512 quantum-safe 5 sha512
sha-224 quantum-safe 1 sha224
sha3-256 quantum-safe 1
sha3-384 quantum-safe 3
sha3-512 quantum-safe 5
blake2 quantum-safe 1 blake2b blake2s
blake3 quantum-safe 1
shake-128 quantum-safe 1 shake128
shake-256 quantum-safe 3 shake256
hmac quantum-safe 1
hmac-sha-256 quantum-safe 1 hmac-sha256
hmac-sha-384 quantum-safe 3
hmac-sha-512 quantum-safe 5
cmac quantum-safe 1
kmac quantum-safe 1
poly1305 quantum-safe 1
gmac quantum-safe 1
pbkdf2 quantum-safe 1
hkdf quantum-safe 1
scrypt quantum-safe 1
bcrypt quantum-safe 1
argon2 quantum-safe 1 argon2i argon2d argon2id
concatkdf quantum-safe 1 concatkdf-hmac x963kdf
ml-kem quantum-safe 5 kyber kyber-512 kyber-768 kyber-1024 crystals-kyber
ml-dsa quantum-safe 5 dilithium dilithium2 dilithium3 dilithium5 crystals-dilithium
slh-dsa quantum-safe 5 sphincs sphincs+ sphincsplus
fn-dsa quantum-safe 5 falcon falcon-512 falcon-1024
xmss quantum-safe 5 xmss-mt
lms quantum-safe 5 hss
bike quantum-safe 1
hqc quantum-safe 1
frodokem quantum-safe 1 frodo
md5 broken 0
md4 broken 0
md2 broken 0
sha-1 broken 0 sha1
des broken 0
3des broken 0 tripledes triple-des
rc2 broken 0
rc4 broken 0
rc5 broken 0
rc6 broken 0
ripemd broken 0 ripemd-160 ripemd160
blowfish broken 0
idea broken 0
cast5 broken 0
cast6 broken 0
skipjack broken 0
whirlpool broken 0
"""


def quantum_rows() -> list[tuple[str, str, int]]:
    """(name, status, level) of every family and its other names."""
    rows = [line.split() for line in QUANTUM.split("\n") if line]
    return [(name, status, int(level)) for family, status, level, *others in rows for name in (family, *others)]


def _any(tokens: tuple[str, ...]) -> str:
    return "(?:" + "|".join(t.replace(".", r"\.") for t in tokens) + ")"


def classify_category(rule_id: Column, severity: Column) -> Column:
    """security or inventory: by the rule id's warning tokens, broken algorithms, discovery tokens, else the severity."""
    low = F.lower(rule_id)
    des = low.rlike("-des(?:-|$)") & ~low.contains("-3des") & ~low.contains("-tripledes")
    return (F.when(low.rlike(_any(SECURITY_TOKENS)) | low.rlike(_any(BROKEN_TOKENS) + "(?:-|$)") | des, "security").when(low.rlike(_any(INVENTORY_TOKENS)), "inventory")
            .when(severity.isin("critical", "high", "medium"), "security").otherwise("inventory"))


def annotate_lifecycle(findings: DataFrame) -> DataFrame:
    """Fill ``category``, ``maturity`` and ``noise_risk`` where they are null or empty; ``default_enabled`` becomes true,
    but the entropy rules are noisy and off whatever they say."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    noisy = F.col("rule_id").isin(*NOISY_RULES)
    own = F.when(noisy, "inventory").otherwise(classify_category(F.col("rule_id"), F.col("severity")))
    return findings.withColumns({
        "category": F.coalesce(given("category"), own), "maturity": F.coalesce(given("maturity"), F.lit("stable")),
        "noise_risk": F.when(noisy, "high").otherwise(F.coalesce(given("noise_risk"), F.lit("low"))), "default_enabled": ~noisy})


def _curve_size(text: Column) -> Column:
    """256, 384 or 521 of a name like P-256."""
    return F.nullif(F.regexp_extract(text, rf"(?i){_LEFT}p-?(256|384|521){_RIGHT}", 1), F.lit("")).cast("int")


def size_in_token(token: Column) -> Column:
    """Key size in a name like AES-256-GCM; null for digests, macs and unknown names."""
    token = F.trim(token)
    flat = F.regexp_replace(token, "[/_ -]+", "-")
    digest = F.upper(token).rlike("^(?:SHA|MD2|MD4|MD5|HMAC|BLAKE|RIPEMD|WHIRLPOOL|SM3)") | F.upper(flat).rlike("^-?(?:SHA|MD2|MD4|MD5)-")
    pattern = rf"(?i)(?:^|-)(?:{'|'.join(SIZED)})-({'|'.join(map(str, SIZES))})(?:-|$)"
    return F.when(~digest, F.coalesce(F.nullif(F.regexp_extract(flat, pattern, 1), F.lit("")).cast("int"), _curve_size(token)))


def size_of_curve(name: Column) -> Column:
    found = F.lower(F.regexp_extract(name, rf"(?i)({'|'.join(CURVES)})", 1))
    return F.coalesce(lookup(found, CURVES), _curve_size(name))


def infer_key_size(size: Column, asset_type: Column, primitive: Column, name: Column, token: Column) -> Column:
    """The given size; for algorithms other than digests else that in the name, the token, or a curve's."""
    found = F.coalesce(size_in_token(name), size_in_token(token), size_of_curve(name), size_of_curve(token))
    return F.when(size > 0, size).when((asset_type == "algorithm") & ~primitive.eqNullSafe(F.lit("hash")), found)


def key_size_of(first: Column, second: Column) -> Column:
    """``key_size`` or ``keySize`` of a finding's properties, where it is a whole number."""
    return F.coalesce(F.nullif(first, F.lit("")), second).try_cast("int")


def quantum_of(family: Column) -> Column:
    """(status, level) of an algorithm family: of its exact name, else without a size or mode at its end; unknown ones have no level."""
    name = F.lower(F.trim(family))
    table = F.create_map(*(x for n, status, level in quantum_rows() for x in (F.lit(n), F.struct(F.lit(status).alias("status"), F.lit(level).alias("level")))))
    short = F.regexp_replace(name, r"(-[a-z]*\d+(-[a-z]+)?|\d+)$", "")
    unknown = F.struct(F.lit("quantum-unknown").alias("status"), F.lit(None).cast("int").alias("level"))
    return F.coalesce(F.try_element_at(table, name), F.try_element_at(table, short), unknown)


def asset_of(token: Column, asset_type: Column) -> Column:
    """The asset type that a marker token stands for, else the given one."""
    out = asset_type
    for asset, tokens in MARKERS.items():
        out = F.when(F.upper(token).isin(*tokens), asset).otherwise(out)
    return out


def annotate_quantum(family: Column, token: Column, asset_type: Column, status: Column, level: Column) -> Column:
    """(status, level): a label that is there stays; else that of the family or token, or of its part before the first
    hyphen. What is no algorithm and what is unknown stays without."""
    family, token = F.nullif(F.trim(family), F.lit("")), F.nullif(F.trim(token), F.lit(""))
    key = F.coalesce(family, lookup(F.upper(token), CURVE_FAMILIES), token)
    whole, start = quantum_of(key), quantum_of(F.when(F.instr(key, "-") > 1, F.substring_index(key, "-", 1)))
    found = F.when(whole.status != "quantum-unknown", whole).otherwise(start)
    none = F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("level"))
    labelled = (F.coalesce(status, F.lit("")) != "") | (F.coalesce(level, F.lit(0)) != 0)
    skip = F.lower(asset_of(token, asset_type)).isin(*NOT_ALGORITHMS) | key.isNull() | (found.status == "quantum-unknown")
    return F.when(labelled, F.struct(status.alias("status"), level.cast("int").alias("level"))).when(F.coalesce(skip, F.lit(False)), none).otherwise(found)


def canonical_primitive(token: Column) -> Column:
    """The canonical spelling of a primitive, or null if the token names none."""
    up = F.upper(F.trim(token))
    parts = F.split(up, "/")
    spec = F.when(F.contains(up, F.lit("/")) & F.get(parts, F.lit(1)).isin(*MODES), F.concat_ws("-", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))))
    up = F.replace(F.get(parts, F.lit(0)), F.lit("_"), F.lit("-"))
    version = lambda prefix, name: F.when(up.startswith(prefix), F.concat(F.lit(name), F.replace(F.substr(up, F.lit(len(prefix) + 1)), F.lit("-"), F.lit("."))))
    kdf = F.regexp_replace(F.regexp_replace(up, "^PBKDF2WITHHMAC-?", "PBKDF2-HMAC-"), "-$", "")
    known = (F.length(up) <= 40) & ~up.rlike(r"[ \t\n\"'`()=]") & up.rlike("^" + _any(PRIMITIVES))
    return F.nullif(F.coalesce(spec, version("TLSV", "TLS-"), version("TLS-VERSION-", "TLS-"), version("SSLV", "SSL-"), F.when(up.startswith("PBKDF2WITHHMAC"), kdf),
                               F.when(up.rlike(r"^SHA(?!3)[+-]?\d+$") & ~up.startswith("SHA-"), F.concat(F.lit("SHA-"), F.substr(up, F.lit(4)))),
                               F.when(up.rlike(r"^SHA3\d+$"), F.concat(F.lit("SHA3-"), F.substr(up, F.lit(5)))), F.when(known, up)), F.lit(""))


def resolve_primitive(static: Column, captured: Column, fallback: Column) -> Column:
    """The rule's own token, else the captured one, else the fallback; only the captured one must be canonical."""
    raw = lambda c: F.coalesce(canonical_primitive(c), F.nullif(F.trim(c), F.lit("")))
    return F.coalesce(raw(static), canonical_primitive(captured), raw(fallback))


def map_engine_fields(rows: DataFrame) -> DataFrame:
    """Defaults and spellings of another engine's rows (severity, confidence, asset_type, category, maturity, noise_risk, default_enabled)."""
    low = lambda c: F.lower(F.trim(c))
    same = lambda c, *values: F.when(low(c).isin(*values), low(c))
    return rows.withColumns({
        "severity": lookup(F.upper(F.trim("severity")), {"ERROR": "high", "WARNING": "medium"}, "info"),
        "confidence": F.coalesce(same("confidence", "high", "medium", "low"), F.lit("medium")),
        "asset_type": F.coalesce(same("asset_type", "algorithm", "protocol", "certificate", "related-crypto-material"), F.nullif(F.col("asset_type"), F.lit("")), F.lit("algorithm")),
        "category": F.coalesce(same("category", "inventory"), F.lit("security")), "maturity": F.coalesce(same("maturity", "experimental", "deprecated"), F.lit("stable")),
        "noise_risk": lookup(low("noise_risk"), {"med": "medium", "medium": "medium", "high": "high"}, "low"), "default_enabled": F.coalesce("default_enabled", F.lit(True))})


def parameter_set(token: Column, size: Column) -> Column:
    """What follows a post-quantum family's name, else the first number in the token, else the key size."""
    up = F.upper(F.trim(token))
    pqc = F.nullif(F.regexp_extract(up, f"^{_any(PQC_PREFIXES)}(.*)$", 1), F.lit(""))
    number = F.get(F.filter(F.split(up, "-"), lambda x: x.rlike(r"^\+?\d+$")), F.lit(0))
    return F.coalesce(pqc, number, F.when(size > 0, size.cast("string")))


def infer_posture(family: Column) -> Column:
    """broken, vulnerable, safe or unknown, as imported documents are judged."""
    # Families by posture.
    low = F.lower(family)
    return (F.when(low.isin("md5", "sha1", "des", "3des", "rc4"), "broken").when(low.isin("rsa", "ecdsa", "ecdh", "dsa", "dh", "ec", "ed25519", "ed448", "x25519", "x448"), "vulnerable")
            .when(low.isin("ml-kem", "ml-dsa", "slh-dsa", "falcon", "bike", "hqc", "classic-mceliece", "frodokem", "ntru", "saber", "kyber", "dilithium", "sphincs", "aes", "sha2", "sha3", "chacha20", "blake2", "blake3"), "safe").otherwise("unknown"))


def signature_hash(algorithm: Column) -> Column:
    """The digest that a signature algorithm uses, or an empty text."""
    # Names of signature algorithms by their digest.
    return lookup(algorithm, {"MD2-RSA": "MD2", "MD5-RSA": "MD5", **dict.fromkeys(("SHA1-RSA", "DSA-SHA1", "ECDSA-SHA1"), "SHA-1"), **dict.fromkeys(("SHA256-RSA", "DSA-SHA256", "ECDSA-SHA256", "SHA256-RSAPSS"), "SHA-256"),
                              **dict.fromkeys(("SHA384-RSA", "ECDSA-SHA384", "SHA384-RSAPSS"), "SHA-384"), **dict.fromkeys(("SHA512-RSA", "ECDSA-SHA512", "SHA512-RSAPSS"), "SHA-512")}, "")


def quantum_recommendation(family: Column, status: Column) -> Column:
    """The advice for a family: by status first, then the first part of its name that fits."""
    low = F.lower(family)
    has = lambda *parts: low.rlike("|".join(parts))
    # The texts.
    return (F.when(status == "broken", "URGENT: Replace immediately. This algorithm is broken by classical attacks.")
            .when(status == "quantum-safe", "No action needed. This algorithm is considered quantum-safe.")
            .when(has("rsa"), "Migrate to ML-KEM (FIPS 203) for key encapsulation or ML-DSA (FIPS 204) for signatures.")
            .when(has("ec"), "Migrate to ML-DSA (FIPS 204) for signatures or ML-KEM (FIPS 203) for key exchange.")
            .when(has("dsa"), "Migrate to ML-DSA (FIPS 204) for digital signatures.")
            .when(has("dh", "diffie"), "Migrate to ML-KEM (FIPS 203) for key encapsulation.")
            .when(has("aes"), "Increase key size to AES-256. AES-256 provides adequate quantum resistance.")
            .when(has("sha") & has("1", "md"), "Migrate to SHA-256 or SHA-3. Current algorithm is weak against classical attacks.")
            .when(has("md5", "md4"), "URGENT: Replace with SHA-256 or SHA-3. MD5 is broken by classical attacks.")
            .when(has("des"), "URGENT: Replace with AES-256-GCM. DES/3DES is no longer considered secure.")
            .when(status == "quantum-vulnerable", "Evaluate NIST PQC standards (FIPS 203/204/205) for quantum-safe replacement.")
            .otherwise("Review algorithm and assess quantum readiness based on latest NIST guidelines."))


def certificate_state(certificates: DataFrame, now: Column) -> DataFrame:
    """``state``, ``severity``, ``category`` and ``validity_days`` from not_before and not_after, and at most ten names of ``sans``."""
    expired, soon = F.col("not_after") < now, F.col("not_after") < now + F.expr("INTERVAL 30 DAYS")
    days = F.floor((F.unix_timestamp("not_after") - F.unix_timestamp("not_before")) / 86400).cast("int")
    more = F.size("sans") - 10
    return certificates.withColumns({
        "state": F.when(expired, "expired").when(soon, "expiring-soon").otherwise("active"), "severity": F.when(expired, "high").when(soon, "medium").otherwise("info"),
        "category": F.when(expired | soon, "security").otherwise("inventory"), "validity_days": F.greatest(F.lit(0), days),
        "sans": F.when(more > 0, F.concat(F.slice("sans", 1, 10), F.array(F.concat(F.lit("(+"), more.cast("string"), F.lit(" more)"))))).otherwise(F.col("sans"))})
