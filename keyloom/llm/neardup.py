"""Operator 1, near-dedup: improved consistent weighted sampling over TF-IDF shingles.

A text is a weighted set: its shingles of ``WORDS`` words, each with its count times its smoothed inverse
document frequency. Frequencies are counted over all documents in ``DF_ROWS`` hash tables of ``DF_BUCKETS`` counters; a
shingle's is the least of its counters less the mean of that table, which is what other shingles add, and one if
that is within three deviations of nothing. No shingle weighs more than one that a ``RARE``-th of the documents holds: a
group of copies makes what they share frequent while what one of them changed stays rare, so that without this
bound copies count as less similar the larger their group and the table are. ``HASHES`` consistent
weighted samples a text, cut into ``BANDS`` bands, put similar texts in common buckets. Candidates are
verified by the weighted Jaccard similarity of the whole sets; links of ``SIMILARITY`` or more are joined to
classes by alternating star contraction.

Equal texts collapse before any of this (they are one class and one vertex). In a bucket every member is
first compared with the least one. Where a bucket then still holds several classes, the members outside
its largest class are compared with all others. A bucket of more than ``TOGETHER`` members comes last, with the
classes of the smaller ones known, and is compared in blocks of two groups, so no pair of classes is left out.

Texts are identified by their MD5, and each different one gets a number. Randomness comes from fixed tables, so results repeat.

Defined results: a null text is a class of its own; texts without a word are linked to nothing but equal
texts; a text of fewer than ``WORDS`` words is one shingle; a class is named by its least doc_id (null
counts as least); ties and repeated rows fall in one class; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.llm.common import WORD_BYTES, WordHashes, dropped, mix, settled, signed, written

WORDS, SIMILARITY = 5, 0.8
#: 16 bands of 4 samples: a pair of similarity 0.8 meets in some band with probability 0.9998.
BANDS, ROWS = 16, 4
HASHES = BANDS * ROWS
DF_BUCKETS, DF_ROWS = 1 << 18, 2
#: A shingle that at most one of so many documents holds has the highest weight.
RARE = 128
#: Members of a bucket and shingles of theirs that are compared at once; a larger one is cut into groups of about half as many.
TOGETHER, ELEMENTS = 2048, 2_000_000
_TABLE = 1 << 16
_CHUNK = 40_000
_SEEN = 200_000


def shingles(text: str, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (32 bits, sorted) and their counts."""
    words = text.lower().encode("utf-8", "replace").translate(WORD_BYTES).split()
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if not len(h):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    n = min(WORDS, len(h))
    total = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        total = total * np.uint64(0x9FB21C651E98DF25) + h[i : len(h) - n + 1 + i]
    out = np.sort((mix(total) >> np.uint64(32)).astype(np.uint32))
    first = np.flatnonzero(np.append(True, out[1:] != out[:-1]))
    return out[first], np.diff(np.append(first, len(out)))


def _buckets(elements: np.ndarray) -> tuple[np.ndarray, ...]:
    """The shingles' counters in each of the tables."""
    other = (elements * np.uint32(0x9E3779B1)) ^ (elements >> np.uint32(15))
    return (elements >> np.uint32(14)).astype(np.int64), (other * np.uint32(0x85EBCA6B) >> np.uint32(14)).astype(np.int64)


def document_frequencies(docs: DataFrame, text: str) -> tuple[int, np.ndarray]:
    """Number of documents and the (DF_ROWS, DF_BUCKETS) counters, over all rows."""

    def count(batches):
        known, sums, n = WordHashes(), np.zeros((DF_ROWS, DF_BUCKETS), np.int64), 0
        for batch in batches:
            for t in (x for at in range(0, batch.num_rows, 256) for x in batch.column(0).slice(at, 256).to_pylist()):
                if t:
                    for own, b in zip(sums, _buckets(shingles(t, known)[0])):
                        np.add.at(own, b, 1)
            n += batch.num_rows
        used = np.flatnonzero(sums)
        yield pa.record_batch([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(sums.ravel()[used], n))], ["bucket", "n"])

    found = docs.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    bucket, n = (found.column(i).to_numpy() for i in range(2))
    out = np.zeros(DF_ROWS * DF_BUCKETS, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return int(n[bucket < 0].sum()), out.reshape(DF_ROWS, DF_BUCKETS)


class InverseFrequencies:
    """log((1 + documents) / (1 + frequency)) + 1 of any shingle, with ``rare`` log(rare) + 1 at most; what is broadcast has a fixed size."""

    def __init__(self, n: int, counters: np.ndarray, rare: int | None = None):
        mean = counters.mean(axis=1, keepdims=True)
        own = counters - mean
        self.top = np.log((1 + n) / 2) + 1 if n else 1.0
        self.tables = np.where(own > 3 * np.sqrt(mean), np.log((1 + n) / (1 + np.maximum(own, 1))) + 1, self.top).astype(np.float32)
        if rare:
            self.tables = np.minimum(self.tables, np.float32(np.log(rare) + 1))

    def __getitem__(self, elements: np.ndarray) -> np.ndarray:
        return np.maximum.reduce([t[b] for t, b in zip(self.tables, _buckets(elements))])


class WeightedSampler:
    """Improved consistent weighted sampling. The random values of an element are rows of fixed tables that
    a hash of the element and the sample's number picks."""

    def __init__(self):
        rng = np.random.default_rng(20240229)
        self.rate = rng.gamma(2.0, 1.0, _TABLE).astype(np.float32)
        self.inverse = (1 / self.rate).astype(np.float32)
        self.offset = rng.random(_TABLE, dtype=np.float32)
        self.cost = np.log(rng.gamma(2.0, 1.0, _TABLE)).astype(np.float32)
        self.factors = rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)

    def bands(self, elements: np.ndarray, weights: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(sets, BANDS) band keys of sets that lie one after another."""
        wide, log_weight = mix(elements.astype(np.uint64) + np.uint64(1)), np.log(weights)
        lengths = np.diff(np.append(starts, len(elements)))
        out = np.zeros((len(starts), BANDS), np.uint64)
        for k, factor in enumerate(self.factors):
            row = ((wide * factor) >> np.uint64(48)).astype(np.int64)
            rate, offset = self.rate[row], self.offset[row]
            step = np.floor(log_weight * self.inverse[row] + offset)
            value = self.cost[row] - rate * (step - offset + 1)
            equal = np.flatnonzero(value == np.repeat(np.minimum.reduceat(value, starts), lengths))
            best = equal[np.searchsorted(equal, starts)]
            sample = mix(wide[best] * np.uint64(0xA24BAED4963EE407) + step[best].astype(np.int64).view(np.uint64))
            band = k // ROWS
            out[:, band] = mix(out[:, band] * np.uint64(0x9FB21C651E98DF25) + sample + np.uint64(band + 1))
        return out


def _key(text: str):
    return F.unhex(F.md5(F.col(text).cast("binary")))


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(tid, key, doc_id, size, bands) of every different text with words: its number, its MD5, the least doc_id of its copies, its shingles. Written."""

    def run(batches: Iterator[pa.RecordBatch]):
        known, sampler, weight, seen = WordHashes(), WeightedSampler(), idf.value, set()

        def emit(ids, docs, sets):
            starts = np.cumsum([0, *(len(e) for e, _ in sets[:-1])])
            elements = np.concatenate([e for e, _ in sets])
            weights = np.concatenate([c for _, c in sets]) * weight[elements]
            keys = signed(sampler.bands(elements, weights.astype(np.float32), starts)).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, BANDS), pa.int32()), pa.array(keys))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(docs, pa.int64()), pa.array([len(e) for e, _ in sets], pa.int64()), lists], names=["key", "doc_id", "size", "bands"])

        ids, own, sets, size = [], [], [], 0
        for part in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            for tid, doc, t in zip(*(part.column(i).to_pylist() for i in range(3))):
                if not t or tid in seen:
                    continue
                if len(seen) > _SEEN:
                    seen.clear()
                seen.add(tid)
                found = shingles(t, known)
                if not len(found[0]):
                    continue
                ids.append(tid), own.append(doc), sets.append(found)
                size += len(found[0])
                if size >= _CHUNK:
                    yield emit(ids, own, sets)
                    ids, own, sets, size = [], [], [], 0
        if ids:
            yield emit(ids, own, sets)

    out = docs.select("key", "doc_id", "text").mapInArrow(run, "key binary, doc_id long, size long, bands array<long>")
    out = out.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    return written(out.select(F.monotonically_increasing_id().alias("tid"), "*"), "signatures")


def _star_pairs(members: DataFrame) -> DataFrame:
    """(a, b): the least member of every bucket with each other one that is not in its class."""
    least = members.groupBy("bucket").agg(F.min(F.struct("tid", "class")).alias("least"))
    return members.join(least, "bucket").where("class <> least.class").select(F.col("least.tid").alias("a"), F.col("tid").alias("b"))


def _open(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Bucket members with their present class, of buckets that still hold several classes; ``n`` members of ``sum`` shingles each."""
    now = members.join(classes, "tid", "left").select("bucket", "tid", "size", F.coalesce("root", "tid").alias("class"))
    several = now.groupBy("bucket").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("n"), F.sum("size").alias("sum")).where("x <> y").select("bucket", "n", "sum")
    return now.join(several, "bucket")


def components(links: DataFrame) -> DataFrame:
    """(tid, root): the least vertex of each linked vertex's component, by alternating large and small stars."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        new = written(small.distinct(), "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(edges)
        edges = new
        if now == state:
            break
        state = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("tid"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("tid"), "root").distinct())


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(tid, elements, counts) of the wanted texts, each from one of its copies."""

    def run(batches):
        known = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [shingles(t, known) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([e.tobytes() for e, _ in found], pa.binary()), pa.array([_packed(c) for _, c in found], pa.binary())], names=["tid", "elements", "counts"])

    return docs.join(wanted, ["key", "doc_id"]).select("tid", "text").mapInArrow(run, "tid long, elements binary, counts binary").dropDuplicates(["tid"])


def _packed(counts: np.ndarray) -> bytes:
    """Counts in 16 bits each if all of them fit, else in 32."""
    return counts.astype(np.uint16 if counts.max(initial=0) < 1 << 16 else np.uint32).tobytes()


def _counts(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32)


def _similarity(a, b, weight: InverseFrequencies) -> float:
    ea, eb = (np.frombuffer(e, np.uint32) for e, _ in (a, b))
    ca, cb = _counts(a[1], len(ea)), _counts(b[1], len(eb))
    at = np.minimum(np.searchsorted(eb, ea), len(eb) - 1)
    same = eb[at] == ea
    shared = float((np.minimum(ca[same], cb[at[same]]) * weight[ea[same]]).sum())
    total = float((ca * weight[ea]).sum() + (cb * weight[eb]).sum())
    return shared / (total - shared) if total > shared else 1.0


def verified(pairs: DataFrame, sets: DataFrame, idf, least: float) -> DataFrame:
    """The pairs (a, b) whose weighted Jaccard similarity is at least ``least``."""

    def run(batches):
        weight = idf.value
        for batch in batches:
            near = []
            for at in range(0, batch.num_rows, 256):
                near += [_similarity(x[:2], x[2:], weight) >= least for x in zip(*(c.slice(at, 256).to_pylist() for c in batch.columns[2:]))]
            a, b = (c.to_pylist() for c in batch.columns[:2])
            yield pa.RecordBatch.from_arrays([pa.array([v for v, k in zip(c, near) if k], pa.int64()) for c in (a, b)], names=["a", "b"])

    one = sets.select(F.col("tid").alias("a"), F.col("elements").alias("ea"), F.col("counts").alias("ca"))
    two = sets.select(F.col("tid").alias("b"), F.col("elements").alias("eb"), F.col("counts").alias("cb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ea", "ca", "eb", "cb").mapInArrow(run, "a long, b long")


def classes_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, root): the MD5 of every text that is linked to a different one, and that of the text which names its class."""
    spark = docs.sparkSession
    n, df = document_frequencies(docs, text)
    idf = spark.sparkContext.broadcast(InverseFrequencies(n, df, RARE))
    rows = docs.select(_key(text).alias("key"), F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    signs = signatures(rows, idf)
    buckets = signs.select("tid", "size", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = written(buckets.join(shared, "bucket"), "members")
    wanted = members.select("tid").distinct().join(signs.select("tid", "key", "doc_id"), "tid")
    sets = written(_sets(rows, wanted), "sets")

    classes, links = spark.createDataFrame([], "tid long, root long"), []

    def joined_by(found: DataFrame) -> DataFrame:
        links.append(written(found, "links"))
        whole = links[0]
        for x in links[1:]:
            whole = whole.unionByName(x)
        return written(components(whole), "classes")

    classes = joined_by(verified(_star_pairs(_open(members, classes)).distinct(), sets, idf, similarity))
    left = written(_open(members, classes), "open")
    fits = (F.col("n") <= TOGETHER) & (F.col("sum") <= ELEMENTS)
    small, large = left.where(fits), left.where(~fits)
    if not small.isEmpty():
        classes = joined_by(_cross_links(small.withColumn("side", F.lit(0)), sets, idf, similarity))
    if not large.isEmpty():
        large = _open(large.select("bucket", "tid", "size"), classes)
        classes = joined_by(_cross_links(_blocks(large), sets, idf, similarity))
    keys = signs.select("tid", "key")
    return classes.join(keys, "tid").join(keys.select(F.col("tid").alias("root"), F.col("key").alias("k")), "root").select("key", F.col("k").alias("root"))


def _links_between(tids: np.ndarray, classes: np.ndarray, sides: np.ndarray, sets: list, weight: InverseFrequencies, least: float) -> list[tuple[int, int]]:
    """Links that join the classes of one group, sorted by side. With one side every member outside the largest
    class is compared with all others, with two every member of the first side with all of the second."""
    names, of = np.unique(classes, return_inverse=True)
    elements = [np.frombuffer(e, np.uint32) for e, _ in sets]
    lengths = np.array([len(e) for e in elements])
    vocabulary, column = np.unique(np.concatenate(elements), return_inverse=True)
    mass = np.concatenate([_counts(c, n) for (_, c), n in zip(sets, lengths)]) * weight[vocabulary][column]
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    total = np.add.reduceat(mass, starts)
    own, links = np.zeros(len(vocabulary), mass.dtype), []
    second = int(np.searchsorted(sides, 1)) if sides[-1] else 0
    at, theirs = starts[second:] - starts[second], slice(starts[second], None)
    for i in range(second) if second else np.flatnonzero(of != np.bincount(of).argmax()):
        mine = slice(starts[i], starts[i] + lengths[i])
        own[column[mine]] = mass[mine]
        shared = np.add.reduceat(np.minimum(mass[theirs], own[column[theirs]]), at)
        own[column[mine]] = 0
        for j in second + np.flatnonzero((shared >= least * (total[second:] + total[i] - shared)) & (of[second:] != of[i])):
            if of[i] != of[j]:
                links.append((int(tids[i]), int(tids[j])))
                of[of == of[j]] = of[i]
        if len(set(of)) == 1:
            break
    return links


def _cross_links(members: DataFrame, sets: DataFrame, idf, least: float) -> DataFrame:
    """Links (a, b) between the classes of groups (``bucket``) of about ``TOGETHER`` members at most, a group at a time."""

    def run(batches):
        weight, group = idf.value, []

        def close():
            if group[0][2]:
                return []
            return _links_between(*(np.array([g[k] for g in group]) for k in (1, 3, 2)), [g[4:] for g in group], weight, least)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and group[0][0] != row[0]:
                    out += close()
                    group = []
                group.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])
        if group and (out := close()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    rows = members.select("bucket", "tid", "side", "class").join(sets, "tid")
    return rows.repartition("bucket").sortWithinPartitions("bucket", "side", "tid").select("bucket", "tid", "side", "class", "elements", "counts").mapInArrow(run, "a long, b long")


def _blocks(large: DataFrame) -> DataFrame:
    """Large buckets as blocks of two groups (``side`` 0 and 1) of about ``TOGETHER / 2`` members and ``ELEMENTS / 2`` shingles at most. The members outside
    the largest class make ``o`` groups, the others ``r``; each of the ``o`` meets itself, those after it and all ``r``."""
    half = max(TOGETHER // 2, 1)
    sizes = large.groupBy("bucket", "class").agg(F.count("*").alias("k"), F.sum("size").alias("s"))
    groups = lambda n, s: F.ceil(F.greatest(n / half, s / (ELEMENTS / 2))).cast("int")
    most = sizes.groupBy("bucket").agg(F.max(F.struct("k", "s", "class")).alias("top"), F.sum("k").alias("n"), F.sum("s").alias("s"))
    most = most.select("bucket", F.col("top.class").alias("top"), groups(F.col("n") - F.col("top.k"), F.col("s") - F.col("top.s")).alias("o"), groups(F.col("top.k"), F.col("top.s")).alias("r"))
    outer = F.col("class") != F.col("top")
    rows = large.join(most, "bucket").withColumn("g", F.pmod(F.xxhash64("tid"), F.when(outer, F.col("o")).otherwise(F.col("r"))).cast("int"))
    rows = rows.withColumn("g", F.when(outer, F.col("g")).otherwise(F.col("g") + F.col("o")))
    other = F.when(outer, F.sequence(F.lit(0), F.col("o") + F.col("r") - 1)).otherwise(F.sequence(F.lit(0), F.col("o") - 1))
    rows = rows.select("bucket", "tid", "class", "g", F.explode(other).alias("h"))
    block = F.xxhash64("bucket", F.least("g", "h"), F.greatest("g", "h"))
    return rows.select(block.alias("bucket"), "tid", "class", (F.col("g") > F.col("h")).cast("int").alias("side"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: its class (the least doc_id in it) and whether it is the one of that name."""
    roots = classes_of(docs, doc_id, text, similarity)
    rows = docs.select(F.col(doc_id).alias("doc_id"), _key(text).alias("key"))
    placed = written(rows.join(written(roots, "roots"), "key", "left").select("doc_id", F.coalesce("root", "key").alias("root")), "placed")
    least = placed.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("k"), "doc_id")).alias("least"), F.count("*").alias("class_size"))
    known = placed.join(written(least, "classes"), "root", "left")
    return known.select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"), F.col("root").alias("class_key"))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return settled(lambda: near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("class_key"), "op1")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays: the one of least doc_id, once if its row is repeated. Null texts stay."""
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("doc"), F.col("_keyloom_tid").alias("tid"))
    roots = settled(lambda: classes_of(docs), "roots").withColumnRenamed("key", "_keyloom_tid")
    ids = docs.select("doc_id", _key("text").alias("_keyloom_tid")).where("_keyloom_tid IS NOT NULL").join(roots, "_keyloom_tid", "left")
    best = ids.groupBy(F.coalesce("root", "_keyloom_tid").alias("root")).agg(F.min(order).alias("o")).select(F.col("o.doc").alias("_keyloom_doc"), F.col("o.tid").alias("_keyloom_tid"))
    keyed = docs.withColumn("_keyloom_tid", _key("text"))
    chosen = keyed.join(best, (keyed["_keyloom_tid"] == best["_keyloom_tid"]) & keyed["doc_id"].eqNullSafe(best["_keyloom_doc"]), "left_semi")
    once = chosen.withColumn("_keyloom_n", F.row_number().over(W.partitionBy("_keyloom_tid", "doc_id").orderBy(F.lit(1)))).where("_keyloom_n = 1")
    return once.select(*docs.columns).unionByName(docs.where("text IS NULL"))
