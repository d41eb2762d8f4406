"""Operator 11, line dedup: two Bloom filters say which lines can repeat, only those are shuffled and confirmed.

1. A scan turns each text into the 64-bit hashes of its distinct line keys; a task keeps a sorted chunk of up to ``CHUNK``
   of them with a mark on those it met in more than one text. Chunks are packed bytes, and lines don't leave their task.
2. Chunks are cut into segments by the hashes' upper bits. A segment has two Bloom filters, of the hashes seen once and of
   those seen again; the segment's task streams through its chunks and needs no more memory than both filters. The second is
   folded to half its length while few of its bits are set, and written.
3. A second scan emits the lines whose hash the second filter may hold: the suspected repeats, with a 128-bit digest of
   the key. Filters of ``FILTER_BYTES`` together are broadcast; beyond that the hashes of all lines travel to the filters'
   tasks instead (a hot line's rows are dealt over ``SALTS`` copies of its filter).
4. The suspects' digests are counted over documents, which is exact, and the first occurrence is chosen in the same
   aggregation. Texts meet the digests that they lose by the MD5 of the text, so that copies are handled once.

A line's key is the line without white space ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased. Each row of the table is
a document. With ``keep="none"`` all lines of a frequent key go; with ``keep="first"`` its first occurrence by id, text
and line number stays (rows equal in id and text are one occurrence).

Defined results: a null or empty text is one empty line; an empty key is never frequent unless ``min_chars`` is 0; a null id is an id like
any other and comes first; repeated rows count each; a text whose lines all go is empty; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import mix, portions, settled, signed, utf8, written

MIN_DOCS, MIN_CHARS = 10, 1
#: Hashes of a task's chunk, and of a segment on average.
CHUNK, SEGMENT = 1 << 20, 1 << 18
#: Bits of the once-seen filter for each hash, probes of a hash, and the share of set bits up to which a filter is folded.
BITS, PROBES, FILL = 8, 3, 0.3
#: The most that is broadcast; copies of a filter where hashes travel.
FILTER_BYTES, SALTS = 64 << 20, 8

_SPACE = b" \t\n\x0b\x0c\r"


def keys_of(text: bytes) -> list[bytes]:
    """The keys of the text's lines, in order."""
    return [line.strip(_SPACE).lower() for line in text.split(b"\n")]


def _distinct(text: bytes, min_chars: int) -> dict[bytes, int]:
    """The keys that are long enough, each with its first line."""
    keys = keys_of(text)
    found = dict(zip(reversed(keys), range(len(keys) - 1, -1, -1)))
    return {k: i for k, i in found.items() if len(k) >= min_chars and (min_chars < 2 or len(k.decode()) >= min_chars)}


def _places(hashes: np.ndarray, mask: np.ndarray | int) -> Iterator[np.ndarray]:
    """A hash's bits in a filter of ``mask`` + 1 of them."""
    h, mask = mix(hashes), np.asarray(mask, np.uint64)
    at, step = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
    for i in range(PROBES):
        yield (at + np.uint64(i) * step) & mask


class Bloom:
    """A Bloom filter whose length is a power of two, with a byte for each bit while it is filled."""

    def __init__(self, length: int):
        self.bits = np.zeros(length, bool)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        found = np.ones(len(hashes), bool)
        for at in _places(hashes, len(self.bits) - 1):
            found &= self.bits[at]
        return found

    def add(self, hashes: np.ndarray) -> None:
        for at in _places(hashes, len(self.bits) - 1):
            self.bits[at] = True

    def packed(self) -> bytes:
        """Folded while few bits are set, eight bits a byte."""
        bits = self.bits
        while len(bits) > 64 and (half := bits[: len(bits) // 2] | bits[len(bits) // 2 :]).mean() <= FILL:
            bits = half
        return np.packbits(bits, bitorder="little").tobytes()


def _segment(hashes: np.ndarray, power: int) -> np.ndarray:
    return hashes >> np.uint64(64 - power) if power else np.zeros(len(hashes), np.uint64)


def _chunks(texts: DataFrame, min_chars: int) -> DataFrame:
    """(n, once, again): sorted distinct hashes of a chunk of texts, apart by whether one text or more hold them. Written."""

    def packed(found: list[np.ndarray]) -> pa.RecordBatch:
        hashes, n = np.unique(np.concatenate(found), return_counts=True)
        row = [[len(hashes)], [hashes[n == 1].tobytes()], [hashes[n > 1].tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), pa.array(row[1], pa.binary()), pa.array(row[2], pa.binary())], names=["n", "once", "again"])

    def run(batches: Iterator[pa.RecordBatch]):
        found, total = [], 0
        for batch in batches:
            for part in portions(batch):
                for text in utf8(part.column(0)):
                    keys = _distinct(text, min_chars)
                    found.append(np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys)))
                    total += len(keys)
                    if total >= CHUNK:
                        yield packed(found)
                        found, total = [], 0
        if total:
            yield packed(found)

    return written(texts.mapInArrow(run, "n long, once binary, again binary"), "chunks")


def _filters(chunks: DataFrame, power: int) -> DataFrame:
    """(segment, bits): the filter of the hashes that are seen again, for each of 2 ** power segments. Written."""

    def cut(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                once, again = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (1, 2))
                whole = np.unique(np.concatenate([_segment(once, power), _segment(again, power)]))
                bounds = [np.append(np.searchsorted(_segment(x, power), whole), len(x)) for x in (once, again)]
                parts = [[x[b[j] : b[j + 1]].tobytes() for j in range(len(whole))] for x, b in zip((once, again), bounds)]
                yield pa.RecordBatch.from_arrays([pa.array(whole.astype(np.int64)), *(pa.array(p, pa.binary()) for p in parts)], names=["segment", "once", "again"])

    def fill(batches: Iterator[pa.RecordBatch]):
        at, seen, repeated = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([repeated.packed()], pa.binary())], names=["segment", "bits"])

        for batch in batches:
            for i in range(batch.num_rows):
                segment = batch.column(0)[i].as_py()
                if segment != at:
                    if at is not None:
                        yield done()
                    at, seen, repeated = segment, Bloom(BITS * SEGMENT), Bloom(BITS * SEGMENT)
                once, again = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (1, 2))
                repeated.add(again)
                repeated.add(once[seen.has(once)])
                seen.add(once)
                seen.add(again)
        if at is not None:
            yield done()

    parts = chunks.mapInArrow(cut, "segment long, once binary, again binary")
    return written(parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(fill, "segment long, bits binary"), "filters")


class _Tables:
    """The filters of all segments, one after another."""

    def __init__(self, rows: list, power: int):
        self.power, n = power, 1 << power
        self.masks, self.starts = np.zeros(n, np.uint64), np.full(n, -1, np.int64)
        at, parts = 0, []
        for segment, bits in rows:
            self.masks[segment], self.starts[segment] = 8 * len(bits) - 1, at
            at += len(bits)
            parts.append(bytes(bits))
        self.bits = np.frombuffer(b"".join(parts) or b"\0", np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        segment = _segment(hashes, self.power).astype(np.int64)
        start = self.starts[segment]
        found = start >= 0
        for at in _places(hashes, self.masks[segment]):
            at = at.astype(np.int64)
            found &= (self.bits[np.maximum(start, 0) + (at >> 3)] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return found


def _suspects(rows: DataFrame, filters: DataFrame, power: int, min_chars: int, most: int) -> DataFrame:
    """(id, text_key, key, line) of the lines whose hash may be repeated; ``line`` is the key's first in its text. Written."""
    spark = rows.sparkSession
    own = f"id {rows.schema['id'].dataType.simpleString()}, text_key binary, key binary, line int"
    size = filters.agg(F.sum(F.octet_length("bits"))).first()[0] or 0
    shared = spark.sparkContext.broadcast(_Tables(filters.collect(), power)) if size <= most else None

    def lines(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in portions(batch, 1):
                texts = utf8(part.column(1))
                found = [_distinct(t, min_chars) for t in texts]
                keys = [k for f in found for k in f]
                hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
                parent = np.repeat(np.arange(len(texts)), [len(f) for f in found])
                line = np.fromiter((i for f in found for i in f.values()), np.int32, len(keys))
                here = np.flatnonzero(shared.value.has(hashes)) if shared else np.arange(len(keys))
                digest = [hashlib.blake2b(keys[i], digest_size=16).digest() for i in here]
                cols = [part.column(0).take(pa.array(parent[here])), pa.array([hashlib.md5(texts[i]).digest() for i in range(len(texts))], pa.binary()).take(pa.array(parent[here])), pa.array(digest, pa.binary()), pa.array(line[here])]
                if not shared:
                    cols += [pa.array(signed(hashes[here]))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "text_key", "key", "line", "hash"][: len(cols)])

    def tested(batches: Iterator[pa.RecordBatch]):
        table = None
        for batch in batches:
            bits, out = batch.column("bits"), []
            segment, hashes = batch.column("segment").to_pylist(), batch.column("hash").fill_null(0).to_numpy().view(np.uint64)
            filled = [i for i, there in enumerate(bits.is_valid().to_pylist()) if there]
            for a, b in zip([0, *filled], [*filled, batch.num_rows]):
                if a < b and bits[a].is_valid:
                    table, a = _Tables([(segment[a], bits[a].as_py())], power), a + 1
                if a < b:
                    out.append(a + np.flatnonzero(table.has(hashes[a:b])))
            here = np.concatenate(out) if out else np.zeros(0, np.int64)
            yield batch.select(["id", "text_key", "key", "line"]).take(pa.array(here))

    if shared:
        out = written(rows.mapInArrow(lines, own), "suspects")
        shared.destroy()
        return out
    all_lines = rows.mapInArrow(lines, own + ", hash long")
    at = F.shiftrightunsigned("hash", 64 - power) if power else F.lit(0).cast("long")
    all_lines = all_lines.select(at.alias("segment"), F.pmod(F.xxhash64("text_key"), F.lit(SALTS)).alias("salt"), F.lit(None).cast("binary").alias("bits"), "*")
    copies = filters.select("segment", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"), "bits", *(F.lit(None).cast(t).alias(n) for n, t in (x.split() for x in (own + ", hash long").split(", "))))
    both = copies.unionByName(all_lines).repartition("segment", "salt").sortWithinPartitions("segment", "salt", F.col("bits").isNull())
    return written(both.mapInArrow(tested, own), "suspects")


def dedupe_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                 keep: str = "none", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """One row per document: its id, the ``text`` that stays, ``n_lines`` before and ``n_dropped``."""
    if keep not in ("none", "first"):
        raise ValueError("keep must be none or first")
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    chunks = _chunks(rows.select("text"), min_chars)
    total = chunks.agg(F.sum("n")).first()[0] or 0
    power = max(0, (total - 1) // SEGMENT).bit_length()
    suspects = _suspects(rows, _filters(chunks, power), power, min_chars, filter_bytes)

    # written, so that Spark knows its size, and may split a key that a third of the texts hold where it joins
    frequent = written(suspects.groupBy("key").agg(F.count("*").alias("n"), *([F.min(F.struct("id", "text_key", "line")).alias("first")] if keep == "first" else [])).where(F.col("n") >= min_docs), "frequent")
    lost = suspects.select("text_key", "key").distinct().join(frequent, "key")
    first = F.when(F.col("first.text_key") == F.col("text_key"), F.struct(F.col("first.id").alias("id"), F.col("first.line").alias("line"))) if keep == "first" else F.lit(None)
    lost = lost.groupBy("text_key").agg(F.collect_list(F.struct("key", first.alias("first"))).alias("lost"))
    keyed = rows.withColumn("own_key", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    met = keyed.join(lost, keyed.own_key == lost.text_key, "left").select("id", "text", F.col("lost.key").alias("keys"), *([F.col("lost.first.id").alias("ids"), F.col("lost.first.line").alias("lines")] if keep == "first" else []))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in portions(batch, 1):
                ids, kept, n_lines, n_dropped = part.column(0).to_pylist(), [], [], []
                others = [part.column(k).to_pylist() for k in range(2, part.num_columns)]
                for i, own in enumerate(utf8(part.column(1))):
                    lines, gone = own.split(b"\n"), set()
                    if others[0][i]:
                        which = {k: j for j, k in enumerate(others[0][i])}
                        for n, k in enumerate(keys_of(own)):
                            j = which.get(hashlib.blake2b(k, digest_size=16).digest())
                            if j is not None and not (keep == "first" and others[2][i][j] == n and others[1][i][j] == ids[i]):
                                gone.add(n)
                    kept.append(b"\n".join(x for n, x in enumerate(lines) if n not in gone) if gone else own)
                    n_lines.append(len(lines))
                    n_dropped.append(len(gone))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], names=["id", "text", "n_lines", "n_dropped"])

    return met.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, text string, n_lines long, n_dropped long").withColumnRenamed("id", doc_id)


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return settled(lambda: dedupe_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")), "op11")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
k AS (SELECT r, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10),
o AS (SELECT r, count(*) AS n_lines, count(*) FILTER (WHERE f.key IS NOT NULL) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '') AS kept FROM k LEFT JOIN f USING (key) GROUP BY r)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN o USING (r)
"""
