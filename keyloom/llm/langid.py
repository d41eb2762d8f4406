"""Operator 9, language ID: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of labelled texts per language with Spark; the log-probability matrix
(languages x 2**15, float32) is broadcast. A batch of texts is a sparse matrix in row form (the buckets of all
its n-grams and where each text's begin), which numpy multiplies by the dense one. Whole texts are scored.

Defined results: a null text, or one without any letter, is ``und`` with score 0; with no labelled
row at all every text is ``und``; ties go to the language that sorts first; repeated rows score alike.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: n-gram lengths in characters and the number of hash buckets (of which the n-grams' are the first).
ORDERS, BUCKETS = (1, 2, 3, 4), 1 << 15
#: About so many labelled rows train the model (a uniform sample by hash of the id beyond it).
TRAIN_ROWS = 20_000
#: More languages than this are refused: the broadcast matrix takes 128 KiB for each.
MAX_LANGS = 2048
#: Characters that are scored at once.
_STEP = 1 << 18


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _folded(text: str) -> np.ndarray:
    """The code points of the lower-cased words, with one space before, between and after them; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return np.zeros(0, np.uint32)
    codes = np.concatenate([[np.uint32(32)], np.where(letter, codes, np.uint32(32)), [np.uint32(32)]])
    return codes[np.append(True, (codes[1:] != 32) | (codes[:-1] != 32))]


def _buckets(codes: np.ndarray) -> list[np.ndarray]:
    """Buckets of all n-grams, in pieces of bounded size."""
    out = []
    for at in range(0, len(codes), _STEP):
        part = codes[at : at + _STEP + max(ORDERS) - 1] + np.uint32(1)
        gram = np.zeros(len(part), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            m = min(len(part) - n + 1, _STEP)
            if m <= 0:
                break
            gram = gram[: len(part) - n + 1] * np.uint32(0x2C1B3C6D) + part[n - 1 :]
            if n in ORDERS:
                mixed = gram[:m] ^ (gram[:m] >> np.uint32(15))
                out.append(((mixed * np.uint32(2654435761) + np.uint32(n * 40503)) >> np.uint32(17)).astype(np.int32))
    return out


def _scores(texts: list[np.ndarray], matrix: np.ndarray) -> np.ndarray:
    """(languages, texts) sums of the log-probabilities of the n-grams of folded texts."""
    total = np.zeros((len(matrix), len(texts)))
    ids, owner, size = [], [], 0

    def add():
        starts = np.cumsum([0, *map(len, ids[:-1])])
        columns = np.concatenate(ids)
        for k, row in enumerate(matrix):
            np.add.at(total[k], owner, np.add.reduceat(row[columns], starts, dtype=np.float64))

    for i, text in enumerate(texts):
        for piece in _buckets(text):
            ids.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= 4 * _STEP:
                add()
                ids, owner, size = [], [], 0
    if ids:
        add()
    return total


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_by: Column | None = None,
          rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and the (languages, BUCKETS) log-probability matrix, with the log prior in a last column.

    ``sample_by`` is a hash column; with more than ``rows`` labelled rows only those whose hash falls in
    the first ``rows / n`` of its range are used.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    total = sum(r.n for r in counts)
    langs = sorted(r.lang for r in counts)
    if not langs:
        return [], np.zeros((0, BUCKETS + 1), np.float32)
    index = {x: i for i, x in enumerate(langs)}
    sample = labelled
    if sample_by is not None and total > rows:
        sample = sample.where(F.pmod(sample_by, F.lit(total)) < rows)

    def count(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for x, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = sums.setdefault(index[x], np.zeros(BUCKETS, np.int64))
                for ids in _buckets(_folded(t)):
                    own += np.bincount(ids, minlength=BUCKETS)
        for k, v in sums.items():
            used = np.flatnonzero(v)
            yield pa.record_batch([pa.array(np.full(len(used), k, np.int32)), pa.array(used.astype(np.int32)), pa.array(v[used])], ["k", "bucket", "n"])

    table = sample.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "k int, bucket int, n long")
    seen = np.zeros((len(langs), BUCKETS), np.float64)
    for r in table.groupBy("k", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        seen[r.k, r.bucket] = r.n
    prior = np.log([max(1, next(r.n for r in counts if r.lang == x)) / total for x in langs])
    matrix = np.log((seen + 0.5) / (seen + 0.5).sum(axis=1, keepdims=True))
    return langs, np.hstack([matrix, prior[:, None]]).astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text: str = "text",
            lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and the posterior probability appended; columns of those names are replaced."""
    spark = docs.sparkSession
    docs = docs.select(*(c for c in docs.columns if c not in (lang_pred, score)))
    shared = spark.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches):
        langs, matrix = shared.value
        rows, prior = np.ascontiguousarray(matrix[:, :-1]), matrix[:, -1:].astype(np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [_folded(t) if t and langs else t or "" for t in part.column(place).to_pylist()]
                known = [i for i, t in enumerate(texts) if langs and len(t)]
                names, scores = ["und"] * len(texts), [0.0] * len(texts)
                if known:
                    total = _scores([texts[i] for i in known], rows) + prior
                    best = total.argmax(axis=0)
                    share = 1 / np.exp(total - total.max(axis=0)).sum(axis=0)
                    for i, k, p in zip(known, best.tolist(), share.tolist()):
                        names[i], scores[i] = langs[k], p
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*(f"c{i}" for i in range(part.num_columns)), "p", "s"])

    types = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    out = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).mapInArrow(run, f"{types}, p string, s double")
    return out.toDF(*docs.columns, lang_pred, score)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4, is 2 (a null id counts as an empty text)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of the labelled documents that are not held out."""
    rows = docs.where(~held_out()).select("doc_id", "text", "lang")
    return train(rows, sample_by=F.xxhash64("doc_id"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: texts that are null or hold no letter go."""
    out = predict(docs, fit(docs), lang_pred="_keyloom_lang", score="_keyloom_score")
    return out.where(F.col("_keyloom_lang") != "und").select(*docs.columns)
