"""The closed vocabularies of the inventory document format: internal spellings are mapped in one pass, in which misses are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from keyloom.functions.crypto import lookup

# Names of the format, with the internal spellings that stand for each.
FAMILIES = {
    "AES": "aes fernet", "RSAES-OAEP": "rsaes-oaep", "RSAES-PKCS1": "rsaes-pkcs1", "RSASSA-PKCS1": "rsassa-pkcs1 rsa", "RSASSA-PSS": "rsassa-pss", "HMAC": "hmac jwt", "DSA": "dsa", "FFDH": "ffdh dh", "ECDSA": "ecdsa ec", "ECDH": "ecdh x25519 x448",
    "ECIES": "ecies", "EdDSA": "eddsa ed25519 ed448", "DES": "des", "3DES": "3des", "Blowfish": "blowfish", "ChaCha": "chacha", "ChaCha20": "chacha20 chacha20-poly1305 nacl", "Poly1305": "poly1305", "CAMELLIA": "camellia", "ARIA": "aria",
    "SM2": "sm2", "SM3": "sm3", "SM4": "sm4", "ML-KEM": "ml-kem kyber classic-mceliece frodokem ntru saber", "ML-DSA": "ml-dsa dilithium falcon", "SLH-DSA": "slh-dsa sphincs", "BIKE": "bike", "HQC": "hqc", "MD2": "md2", "MD4": "md4", "MD5": "md5",
    "SHA-1": "sha1 sha-1", "SHA-2": "sha sha2 sha-2 sha-224 sha-256 sha-384 sha-512 sha256 sha384 sha512", "SHA-3": "sha3 sha-3 sha3-256 sha3-384 sha3-512 shake128 shake256", "BLAKE2": "blake2 blake2b blake2s", "BLAKE3": "blake3", "RC2": "rc2", "RC4": "rc4",
    "RC5": "rc5", "RC6": "rc6", "IDEA": "idea", "CAST5": "cast cast5", "CAST6": "cast6", "Twofish": "twofish", "Serpent": "serpent", "SEED": "seed", "RIPEMD": "ripemd ripemd160", "Whirlpool": "whirlpool", "CMAC": "cmac aes-cmac 3des-cmac", "KMAC": "kmac",
    "HKDF": "hkdf concatkdf concatkdf-hmac x963kdf", "PBKDF1": "pbkdf1", "PBKDF2": "pbkdf2", "scrypt": "scrypt", "bcrypt": "bcrypt", "Argon2": "argon2", "GOST": "gost", "Salsa20": "salsa20 xsalsa20", "Fortuna": "fortuna",
}
FUNCTIONS = {
    "generate": "generate", "keygen": "keygen key-agreement keyagree key-agree", "encrypt": "encrypt cipher-suite seal", "decrypt": "decrypt open", "digest": "digest hash", "tag": "tag mac", "keyderive": "keyderive derive passwordhash keydrive",
    "sign": "sign", "verify": "verify", "encapsulate": "encapsulate", "decapsulate": "decapsulate", "other": "other", "unknown": "unknown",
}
MATERIALS = {
    **{m: m for m in ("private-key", "public-key", "key", "ciphertext", "signature", "digest", "nonce", "seed", "salt", "shared-secret", "tag", "additional-data", "password", "credential", "token", "other", "unknown")},
    "secret-key": "secret-key symmetric-key", "initialization-vector": "initialization-vector iv",
}
PADDINGS = {"pkcs5": "pkcs5 pkcs5padding", "pkcs7": "pkcs7 pkcs7padding", "pkcs1v15": "pkcs1v15 pkcs1padding", "oaep": "oaep oaepwithsha-256andmgf1padding oaepwithsha-1andmgf1padding", "raw": "raw nopadding none", "other": "other", "unknown": "unknown"}
MODES = {**{m: m for m in ("cbc", "ecb", "ccm", "gcm", "cfb", "ofb", "ctr")}, "other": "eax xts siv ocb"}
PRIMITIVES = {
    **{p: p for p in ("block-cipher", "stream-cipher", "hash", "mac", "signature", "pke", "kdf", "kem", "xof", "drbg", "combiner", "key-wrap", "unknown")},
    "key-agree": "key-agree key-exchange", "ae": "ae aead", "other": "other protocol",
}
PROTOCOLS = {**{p: p for p in ("ssh", "ipsec", "ike", "sstp", "wpa", "dtls", "quic", "eap-aka", "eap-aka-prime", "prins", "5g-aka", "other", "unknown")}, "tls": "tls ssl"}

#: Field -> (vocabulary, what an unknown value becomes: "" is left out, None stays as it is).
FIELDS: dict[str, tuple[dict[str, str], str | None]] = {
    "family": (FAMILIES, ""), "function": (FUNCTIONS, None), "material": (MATERIALS, "other"), "padding": (PADDINGS, None), "mode": (MODES, "other"), "primitive": (PRIMITIVES, "other"), "protocol": (PROTOCOLS, "other"),
}


def _mapped(value: Column, table: dict[str, str]) -> Column:
    """The format's name of a spelling, or null."""
    return lookup(F.lower(F.trim(value)), {spelling: name for name, spellings in table.items() for spelling in spellings.split()}, F.lit(None).cast("string"))


def document_value(value: Column, field: str) -> Column:
    """The format's value of a field; a null or empty one is empty."""
    table, unknown = FIELDS[field]
    return F.when(F.coalesce(value, F.lit("")) == "", "").otherwise(F.coalesce(_mapped(value, table), value if unknown is None else F.lit(unknown)))


def normalise_document(rows: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, Observation]:
    """``rows`` with the format's values in ``columns`` (column -> field), and an observation of that pass that counts the values outside of
    each vocabulary as ``<column>_misses``. It can be read once the result has been computed."""
    seen = Observation()
    misses = [F.count_if((F.coalesce(F.col(c), F.lit("")) != "") & _mapped(F.col(c), FIELDS[f][0]).isNull()).alias(f"{c}_misses") for c, f in columns.items()]
    return rows.observe(seen, *misses).withColumns({c: document_value(F.col(c), f) for c, f in columns.items()}), seen
