"""Operator 10, benchmark decontamination: a distributed positional inverted index.

``build_index`` stores the corpus as index shards in the shared folder: a shard is some thousand whole
documents with, for each distinct term, the sorted positions of its occurrences (documents lie one after
another with a gap between them, so no phrase runs over an end). A Spark job cuts the items into a written table of
their distinct windows and another of which items hold them.

Up to ``BROADCAST`` windows are searched in every shard at once. Of more, the shards first say which of the terms they hold and how often; a Bloom filter of those terms, of bounded size,
keeps other terms where they are. Summed over shards that gives each term's frequency: a window with a term that no shard holds is done,
any other joins by its rarest term the shards that hold it, in one shuffle. A shard meets its windows, up to
``BLOCK_WINDOWS`` in a row, in a join by the shard's number that reads the index once, whatever the number of windows. In a shard the list
of a window's rarest term is intersected with the offset-adjusted lists of the others, rarest first. Survivors of the first pass, in
which each term need only occur in the same document within a window's length (and ``slack``), are the proximity
matches; those with every term at its place are the exact ones. The items join by the window's number.

Terms are 64-bit hashes of words. Words are runs of letters, digits and bytes from 0x80 up, A-Z
lower-cased. A window is ``WINDOW`` consecutive words of an item; an item of fewer words is one window.

Defined results: a null or wordless text has no words and no hits; a null or wordless item has no
window; a null item_id marks words as hit and is not listed; repeated rows count each; empty tables give
no rows or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import WORD_BYTES, WordHashes, dropped, mix, portions, settled, signed, utf8, written

WINDOW = 10
#: Words of one index shard, windows that are broadcast at most (some 50 MB), windows that meet a shard in one row otherwise, and
#: the most bits of the terms' filter.
SHARD_WORDS, BROADCAST, BLOCK_WINDOWS, FILTER_BITS = 250_000, 300_000, 20_000, 1 << 28

INDEX = "shard long, texts array<string>, ids array<long>, n_words array<int>, starts binary, terms binary, ends binary, positions binary"


def _shard(number: int, ids: list, texts: list, words: list[np.ndarray]) -> pa.RecordBatch:
    """Postings of some documents: positions sorted by term, and where each term's list ends."""
    n = np.array([len(w) for w in words], np.int64)
    starts = np.concatenate([[0], np.cumsum(n + 1)[:-1]])
    terms = np.concatenate(words) if len(words) else np.zeros(0, np.uint64)
    place = np.arange(len(terms)) + np.repeat(np.arange(len(n)), n)
    order = np.argsort(terms, kind="stable")
    terms = terms[order]
    last = np.flatnonzero(np.append(terms[1:] != terms[:-1], True)) if len(terms) else np.zeros(0, np.int64)
    blob = lambda x, t: x.astype(t).tobytes()
    row = [number, texts, ids, n.tolist(), blob(starts, np.int32), blob(terms[last], np.uint64), blob(last + 1, np.int32), blob(place[order], np.int32)]
    types = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=[x.split()[0] for x in INDEX.split(", ")])


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The corpus as a written table of index shards; ``texts`` holds the MD5 of each text."""

    def run(batches: Iterator[pa.RecordBatch]):
        known, number = WordHashes(), TaskContext.get().partitionId() << 32
        ids, keys, words, total = [], [], [], 0
        for batch in batches:
            own_ids, own_keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i in range(batch.num_rows):
                data = utf8(batch.column(2).slice(i, 1))[0].translate(WORD_BYTES).split()
                ids.append(own_ids[i])
                keys.append(own_keys[i])
                words.append(np.fromiter(map(known.__getitem__, data), np.uint64, len(data)))
                total += len(data)
                if total >= SHARD_WORDS or len(ids) >= SHARD_WORDS // 20:
                    yield _shard(number, ids, keys, words)
                    ids, keys, words, total, number = [], [], [], 0, number + 1
        if ids:
            yield _shard(number, ids, keys, words)

    rows = docs.select(F.col(doc_id).cast("long").alias("i"), F.md5(F.col(text).cast("binary")).alias("k"), F.col(text).alias("t"))
    return written(rows.mapInArrow(run, INDEX), "postings", row_bytes=4 << 20)


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (window, terms), and which windows an item holds (window, item). Written."""

    def run(batches: Iterator[pa.RecordBatch]):
        known = WordHashes()
        for batch in batches:
            for part in portions(batch, 1):
                for item, data in zip(part.column(0).to_pylist(), utf8(part.column(1))):
                    words = data.translate(WORD_BYTES).split()
                    terms = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    n = min(size, len(terms))
                    starts = range(len(terms) - n + 1 if n else 0)
                    for at in range(0, len(starts), 10_000):
                        found = list({terms[i : i + n].tobytes() for i in starts[at : at + 10_000]})
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(found, pa.binary())], names=["item", "terms"])

    rows = written(items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).mapInArrow(run, "item string, terms binary"), "cut")
    distinct = written(rows.select("terms").distinct().select(F.monotonically_increasing_id().alias("window"), "terms"), "windows")
    held = written(rows.where("item IS NOT NULL").join(distinct, "terms").select("window", "item").distinct(), "held")
    dropped(rows)
    return distinct, held


def _terms_of(tests: DataFrame) -> DataFrame:
    """(window, term) of every distinct term of a window."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                own = [np.unique(np.frombuffer(t, np.int64)) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(own)), [len(t) for t in own]))), pa.array(np.concatenate(own))], names=["window", "term"])

    return tests.select("window", "terms").mapInArrow(run, "window long, term long")


def _bits(terms: np.ndarray, length: int) -> np.ndarray:
    """Two places of each term in a filter of ``length`` bits."""
    h = mix(terms)
    return np.concatenate([h & np.uint64(length - 1), h >> np.uint64(32) & np.uint64(length - 1)]).astype(np.int64)


def _term_filter(terms: DataFrame) -> np.ndarray:
    """A Bloom filter of the terms, 16 bits each up to ``FILTER_BITS``; tasks fill their own, Spark brings them together by position."""
    count = terms.select("term").distinct().count()
    length = min(FILTER_BITS, 1 << max(10, (16 * max(1, count) - 1).bit_length()))
    word = 1 << 16  # the filter is added up in pieces of so many bits

    def run(batches: Iterator[pa.RecordBatch]):
        bits = np.zeros(length, bool)
        for batch in batches:
            bits[_bits(batch.column(0).to_numpy().view(np.uint64), length)] = True
        for at in range(0, length, word):
            if (part := bits[at : at + word]).any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([np.packbits(part).tobytes()], pa.binary())], names=["at", "bits"])

    out = np.zeros(length // 8, np.uint8)
    for r in terms.select("term").mapInArrow(run, "at long, bits binary").toLocalIterator():
        part = np.frombuffer(bytes(r.bits), np.uint8)
        out[r.at // 8 : r.at // 8 + len(part)] |= part
    return out


def _held_terms(index: DataFrame, terms: DataFrame) -> DataFrame:
    """(shard, term, n) of the terms that the filter knows. Written."""
    shared = index.sparkSession.sparkContext.broadcast(_term_filter(terms))

    def run(batches: Iterator[pa.RecordBatch]):
        bits = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                terms, ends = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((1, np.uint64), (2, np.int32)))
                at = _bits(terms, 8 * len(bits)).reshape(2, -1)
                here = np.flatnonzero((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).all(axis=0)) if len(terms) else np.zeros(0, np.int64)
                n = np.diff(ends, prepend=np.int32(0))[here].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), batch.column(0)[i].as_py(), np.int64)), pa.array(signed(terms[here].copy())), pa.array(n)], names=["shard", "term", "n"])

    out = written(index.select("shard", "terms", "ends").mapInArrow(run, "shard long, term long, n long"), "terms")
    shared.destroy()
    return out


def _meetings(index: DataFrame, tests: DataFrame) -> DataFrame:
    """(shard, windows): the windows whose rarest term the shard holds, each as (window, terms). Written."""
    terms = written(_terms_of(tests), "test-terms")
    held = _held_terms(index, terms)
    frequency = written(held.groupBy("term").agg(F.sum("n").alias("n")), "frequency")
    rarest = terms.join(frequency, "term", "left").groupBy("window").agg(F.min_by("term", F.struct("n", "term")).alias("term"), F.count_if(F.col("n").isNull()).alias("missing"))
    rarest = rarest.where("missing = 0").select("window", "term").join(tests, "window")
    met = held.select("shard", "term").join(rarest, "term").select("shard", F.struct("window", "terms").alias("w"))
    blocks = max(1, -(-tests.count() // BLOCK_WINDOWS))
    return written(met.groupBy("shard", F.pmod(F.xxhash64("w.window"), F.lit(blocks)).alias("block")).agg(F.collect_list("w").alias("windows")), "meetings")


HITS = "shard long, doc int, window long, n int, near array<int>, exact array<int>"


def _matches(index, rows, lengths, slack: int):
    """(window's place in the block, near starts, exact starts) of every window that is found, near or exact. A near
    start is a place of the rarest term with all others around it in the document."""
    starts, stops, ends, positions, lists, there = index
    begins = np.concatenate([[0], ends[:-1]])
    length = np.where(there, ends[lists] - begins[lists], 0)
    whole = (there[rows] | (np.arange(rows.shape[1]) >= lengths[:, None])).all(axis=1)
    for w in np.flatnonzero(whole).tolist():
        n = int(lengths[w])
        own = rows[w][:n]
        order = np.argsort(length[own], kind="stable")
        rare = order[0]
        post = [positions[begins[k] : ends[k]] for k in lists[own]]
        at, reach = post[rare], n - 1 + slack
        doc = np.searchsorted(starts, at, "right") - 1
        low, high = np.maximum(at - reach, starts[doc]), np.minimum(at + reach, stops[doc])
        for j in order[1:]:
            k = np.minimum(np.searchsorted(post[j], low), len(post[j]) - 1)
            near = (post[j][k] >= low) & (post[j][k] <= high)
            at, low, high = at[near], low[near], high[near]
            if not len(at):
                break
        if not len(at):
            continue
        exact = at - rare
        for j in order[1:]:
            k = np.minimum(np.searchsorted(post[j], exact + j), len(post[j]) - 1)
            exact = exact[post[j][k] == exact + j]
            if not len(exact):
                break
        yield w, at, exact


class _Tests:
    """Windows by number: their distinct terms, sorted, and the places of each window's terms among those."""

    def __init__(self, numbers: list[int], terms: list[bytes]):
        cut = [np.frombuffer(t, np.uint64) for t in terms]
        self.numbers, self.lengths = numbers, np.array([len(r) for r in cut], np.int64)
        self.terms = np.unique(np.concatenate(cut)) if cut else np.zeros(0, np.uint64)
        self.rows = np.zeros((len(cut), max(map(len, cut), default=0)), np.int32)
        for i, r in enumerate(cut):
            self.rows[i, : len(r)] = np.searchsorted(self.terms, r)

    def found(self, number: int, starts, terms, ends, positions, slack: int):
        """Rows of HITS of one shard."""
        if not len(terms) or not len(self.rows):
            return
        lists = np.searchsorted(terms, self.terms)
        lists[lists == len(terms)] = 0
        stops = np.append(starts[1:] - 2, np.iinfo(np.int32).max)
        for w, near, exact in _matches((starts, stops, ends, positions, lists, terms[lists] == self.terms), self.rows, self.lengths, slack):
            of_near, of_exact = (np.searchsorted(starts, x, "right") - 1 for x in (near, exact))
            for d in np.unique(of_near).tolist():
                yield number, d, self.numbers[w], int(self.lengths[w]), near[of_near == d].tolist(), exact[of_exact == d].tolist()


def search(index: DataFrame, tests: DataFrame, slack: int = 0) -> DataFrame:
    """Matches of windows, given as (window, terms): a row for each document and window, positions count from
    the shard's start. ``near`` are places of the rarest term, ``exact`` starts of the whole phrase. Written.

    Up to ``BROADCAST`` windows are searched in every shard, more of them only where they can occur."""
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
    shared = None
    if len(few := tests.select("window", "terms").limit(BROADCAST + 1).collect()) <= BROADCAST:
        shared = index.sparkSession.sparkContext.broadcast(_Tests([r.window for r in few], [bytes(r.terms) for r in few]))
    del few

    def run(batches: Iterator[pa.RecordBatch]):
        batch_of = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [()] * 6, types)], names=[x.split()[0] for x in HITS.split(", ")])
        for batch in batches:
            for i in range(batch.num_rows):
                own = (np.frombuffer(batch.column(k)[i].as_buffer(), t) for k, t in ((1, np.int32), (2, np.uint64), (3, np.int32), (4, np.int32)))
                own_tests = shared.value if shared else _Tests(batch.column(5)[i].values.field("window").to_pylist(), batch.column(5)[i].values.field("terms").to_pylist())
                out = []
                for row in own_tests.found(batch.column(0)[i].as_py(), *own, slack):
                    out.append(row)
                    if len(out) == 4096:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

    rows = index.select("shard", "starts", "terms", "ends", "positions")
    if not shared:
        rows = rows.join(_meetings(index, tests).select("shard", "windows"), "shard").select(*rows.columns, "windows")
    out = written(rows.mapInArrow(run, HITS), "hits")
    if shared:
        shared.destroy()
    return out


def _found(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, slack: int = 0):
    """The index's documents (shard, doc, doc_id, text_key, n_words), all matches, and the items that hold each window."""
    index = build_index(docs, doc_id, text)
    base = index.select("shard", F.posexplode(F.arrays_zip("ids", "texts", "n_words")).alias("doc", "d")).select("shard", "doc", F.col("d.ids").alias("doc_id"), F.col("d.texts").alias("text_key"), F.col("d.n_words").cast("long").alias("n_words"))
    tests, held = windows(items, item_id, item_text)
    return index, base, search(index, tests, slack), held


def matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", slack: int = 0) -> DataFrame:
    """One row per document, item and window found in it: ``exact`` word positions where the window starts in the
    document, and ``near`` ones of its rarest term where all terms stand together. A null item id is not listed."""
    index, base, hits, held = _found(docs, items, doc_id, text, item_id, item_text, slack)
    starts = index.select("shard", F.posexplode("n_words").alias("doc", "n")).withColumn("n", F.col("n") + 1)
    before = Window.partitionBy("shard").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("shard", "doc", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int").alias("at"))
    rows = hits.join(starts, ["shard", "doc"]).join(base.select("shard", "doc", "doc_id"), ["shard", "doc"]).join(held, "window")
    here = lambda c: F.transform(c, lambda x: x - F.col("at")).alias(c)
    return rows.select("doc_id", F.col("item").alias("item_id"), "window", F.col("n").alias("n_words"), here("exact"), here("near"))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: words, hit words, items found, contaminated; ``text_key`` is the text's MD5."""
    _, base, hits, held = _found(docs, items, doc_id, text, item_id, item_text)
    none = F.array().cast("array<string>")
    runs = hits.where(F.size("exact") > 0).groupBy("shard", "doc").agg(F.array_sort(F.flatten(F.collect_list(F.expr("transform(exact, x -> struct(x AS starts, x + n AS ends))")))).alias("runs"))
    covered = F.aggregate("runs", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).alias("end")),
                          lambda a, r: F.struct((a.n + F.greatest(F.lit(0), r.ends - F.greatest(a.end, r.starts))).alias("n"), F.greatest(a.end, r.ends).alias("end"))).n
    runs = runs.select("shard", "doc", covered.alias("n_hit"))
    listed = hits.join(held, "window").groupBy("shard", "doc").agg(F.array_sort(F.collect_set(F.when(F.size("exact") > 0, F.col("item")))).alias("items"), F.count_distinct("item").alias("n_near"))
    items_of, n_hit = F.coalesce("items", none), F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.join(runs, ["shard", "doc"], "left").join(listed, ["shard", "doc"], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "text_key")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    return settled(lambda: decontaminate(read("documents"), read("benchmark")).drop("text_key", "n_near"), "op10")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; contamination depends on the text alone, so its key joins."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bad = settled(lambda: decontaminate(docs, items).where("contaminated").select(F.col("text_key").alias("_keyloom_key")).distinct(), "contaminated")
    keyed = docs.withColumn("_keyloom_own", F.md5(F.col("text").cast("binary")))
    return keyed.join(bad, F.col("_keyloom_own") == F.col("_keyloom_key"), "left_anti").select(*docs.columns)


#: Windows of every length that an item has; the array positions of the documents' words are joined to them.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT r, item, i, dw.n FROM dw JOIN bw USING (n, g)),
k AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k USING (r) LEFT JOIN t USING (r)
"""
