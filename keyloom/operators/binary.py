"""Crypto constants in binary content: one automaton over all of them, one read of the content.

A constant is found where its first ``min_match`` bytes stand. Of the constants of a (family, primitive) the first one in the table's order that
occurs counts, at its first place. Tables of the standards are computed from their rules, object identifiers are encoded from
their numbers.

Defined results: null or empty content has no constant; a ``min_match`` of 0, or one beyond the constant, takes the whole constant; equal
beginnings are found for each of their constants; content of any size is one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import isqrt
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ByteConstant(NamedTuple):
    name: str
    family: str
    primitive: str
    data: bytes
    min_match: int = 0

    @property
    def needle(self) -> bytes:
        return self.data[: self.min_match] if 0 < self.min_match <= len(self.data) else self.data


# Severity of a constant's family; others are for information.
SEVERITY = {"des": "high", "md5": "high", "rc4": "high", "sha1": "high", "blowfish": "medium"}


def _primes(n: int) -> list[int]:
    out: list[int] = []
    k = 2
    while len(out) < n:
        if all(k % p for p in out):
            out.append(k)
        k += 1
    return out


def _cube_root(x: int) -> int:
    lo, hi = 0, 1 << (x.bit_length() // 3 + 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if mid**3 <= x else (lo, mid - 1)
    return lo


def _aes_box() -> list[int]:
    """Inverses in GF(2^8), put through the affine map."""
    power, log, x = [0] * 255, {}, 1
    for i in range(255):
        power[i], log[x] = x, i
        x ^= (x << 1) ^ (0x11B if x & 0x80 else 0)
    out = []
    for b in range(256):
        inverse = power[-log[b] % 255] if b else 0
        out.append(0x63 ^ inverse ^ _rotated(inverse, 1) ^ _rotated(inverse, 2) ^ _rotated(inverse, 3) ^ _rotated(inverse, 4))
    return out


def _rotated(b: int, n: int) -> int:
    return (b << n | b >> (8 - n)) & 0xFF


def _pi_words(n: int) -> list[int]:
    """The first n words of 32 bits behind the point of pi, by Machin's formula."""
    unit = 1 << (32 * n + 64)

    def arctan(inverse: int) -> int:
        term, total, k = unit // inverse, 0, 0
        while term:
            total += (-1) ** k * (term // (2 * k + 1))
            term, k = term // inverse**2, k + 1
        return total

    fraction = (16 * arctan(5) - 4 * arctan(239) - 3 * unit) >> 64
    return [fraction >> (32 * (n - 1 - i)) & 0xFFFFFFFF for i in range(n)]


def _oid(numbers: str) -> bytes:
    """The body of an object identifier in DER."""
    a, b, *rest = map(int, numbers.split("."))
    out = bytearray([40 * a + b])
    for n in rest:
        part = [n & 0x7F]
        while n := n >> 7:
            part.append(n & 0x7F | 0x80)
        out += bytes(reversed(part))
    return bytes(out)


@lru_cache(1)
def known_constants() -> tuple[ByteConstant, ...]:
    """Tables and identifiers of common algorithms; the order decides within a (family, primitive)."""
    from math import floor, sin

    words = lambda values, order: b"".join(v.to_bytes(4, order) for v in values)
    box = _aes_box()
    inverse = [box.index(i) for i in range(256)]
    sha256 = [_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)]
    sha512 = [_cube_root(p << 192) & 0xFFFFFFFFFFFFFFFF for p in _primes(16)]
    md5 = [floor(abs(sin(i + 1)) * 2**32) for i in range(16)]
    start = [isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)]
    sha1 = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0xC3D2E1F0]
    permutation = [58 - 8 * column + row for row in (0, 2, 4, 6, -1, 1, 3, 5) for column in range(8)]
    return (
        ByteConstant("AES S-box", "aes", "block-cipher", bytes(box[:64]), 32),
        ByteConstant("AES inverse S-box", "aes", "block-cipher", bytes(inverse[:64]), 32),
        ByteConstant("SHA-256 round constants", "sha-256", "hash", words(sha256, "big"), 16),
        ByteConstant("SHA-256 round constants, little-endian", "sha-256", "hash", words(sha256, "little"), 16),
        ByteConstant("SHA-256 initial state, little-endian", "sha-256", "hash", words(start, "little"), 16),
        ByteConstant("SHA-512 round constants", "sha-512", "hash", b"".join(v.to_bytes(8, "big") for v in sha512), 16),
        ByteConstant("SHA-512 round constants, little-endian", "sha-512", "hash", b"".join(v.to_bytes(8, "little") for v in sha512), 16),
        ByteConstant("SHA-1 initial state", "sha1", "hash", words(sha1, "big"), 20),
        ByteConstant("SHA-1 initial state, little-endian", "sha1", "hash", words(sha1, "little"), 20),
        ByteConstant("MD5 table", "md5", "hash", words(md5, "little"), 16),
        ByteConstant("DES initial permutation", "des", "block-cipher", bytes(permutation), 16),
        ByteConstant("Blowfish P-array", "blowfish", "block-cipher", words(_pi_words(18), "big"), 16),
        ByteConstant("Blowfish P-array, little-endian", "blowfish", "block-cipher", words(_pi_words(18), "little"), 16),
        ByteConstant("ChaCha20 constant", "chacha20", "stream-cipher", b"expand 32-byte k"),
        ByteConstant("RC4 initial state", "rc4", "stream-cipher", bytes(range(64)), 32),
        ByteConstant("RSA identifier", "rsa", "pke", _oid("1.2.840.113549.1.1")),
        ByteConstant("ECDSA identifier", "ecdsa", "signature", _oid("1.2.840.10045.4.3")),
        ByteConstant("Ed25519 identifier", "ed25519", "signature", _oid("1.3.101.112")),
        ByteConstant("AES-CBC identifier", "aes", "block-cipher", _oid("2.16.840.1.101.3.4.1.2")),
        ByteConstant("AES-GCM identifier", "aes", "ae", _oid("2.16.840.1.101.3.4.1.6")),
        ByteConstant("SHA-256 identifier", "sha-256", "hash", _oid("2.16.840.1.101.3.4.2.1")),
        ByteConstant("SHA-512 identifier", "sha-512", "hash", _oid("2.16.840.1.101.3.4.2.3")),
        ByteConstant("MD5 identifier", "md5", "hash", _oid("1.2.840.113549.2.5")),
    )


def scan_byte_constants(files: DataFrame, constants: tuple[ByteConstant, ...] | None = None) -> DataFrame:
    """(path, name, family, primitive, severity, at) of ``files`` (path, content as bytes or text); ``at`` counts bytes from 0."""
    table = tuple(constants if constants is not None else known_constants())

    def run(batches: Iterator[pa.RecordBatch]):
        import ahocorasick

        by_needle: dict[str, list[int]] = {}
        for i, c in enumerate(table):
            if c.needle:
                by_needle.setdefault(c.needle.decode("latin-1"), []).append(i)
        automaton = ahocorasick.Automaton()
        for needle, which in by_needle.items():
            automaton.add_word(needle, (len(needle), which))
        if by_needle:
            automaton.make_automaton()
        for batch in batches:
            rows = []
            for k in range(batch.num_rows if by_needle else 0):
                data = batch.column(1)[k]
                if not data.is_valid:
                    continue
                first: dict[int, int] = {}
                for end, (length, which) in automaton.iter(str(data.as_buffer(), "latin-1")):
                    if which[0] not in first:
                        first.update(dict.fromkeys(which, end - length + 1))
                seen = set()
                for i in sorted(first):
                    c = table[i]
                    if (c.family, c.primitive) not in seen:
                        seen.add((c.family, c.primitive))
                        rows.append((k, c.name, c.family, c.primitive, SEVERITY.get(c.family, "info"), first[i]))
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, pa.string()) for c in cols[1:5]), pa.array(cols[5], pa.int64())], names=["path", "name", "family", "primitive", "severity", "at"])

    kind = files.schema["path"].dataType.simpleString()
    return files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(run, f"path {kind}, name string, family string, primitive string, severity string, at long")
