"""Line dedup, fill-in-middle and vector codes against SQL, brute force and exact round trips."""

import hashlib
import math
import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import codes, fim, linedup, queries

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", ["op11_line_dedup", "op12_fill_in_middle", "op13_vector_codes"])
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    got = queries.QUERIES[name](spark, SF)
    want = c.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) != []


# --- line dedup


def lines_by_hand(docs, least, min_chars=1, keep="none"):
    """(id, text, lines, dropped) of (id, text) rows, in their order."""
    keyed = [[x.strip(SPACE).translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")] for _, t in docs]
    n = Counter(k for own in keyed for k in set(own) if len(k) >= min_chars)
    bad, first = {k for k, m in n.items() if m >= least}, {}
    for (i, t), own in sorted(zip(docs, keyed), key=lambda x: (x[0][0] is not None, x[0][0] or 0, hashlib.md5((x[0][1] or "").encode()).digest())):
        for at, k in enumerate(own):
            first.setdefault(k, (i, t or "", at))
    out = []
    for (i, t), own in zip(docs, keyed):
        gone = {at for at, k in enumerate(own) if k in bad and not (keep == "first" and first[k] == (i, t or "", at))}
        out.append((i, "\n".join(x for at, x in enumerate((t or "").split("\n")) if at not in gone), len(own), len(gone)))
    return out


def test_lines_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["", " ", "Home", "home\t", "HOME ", "ÄRGER", "ärger", "\x0bMenu", "Menu\x85", "a", "long line " * 3000] + [f"own line {i}" for i in range(300)]
    docs = [(int(i), None if i % 17 == 0 else "\n".join(rng.choice(words, rng.integers(0, 12)))) for i in range(200)]
    docs += [docs[5], docs[5], (None, "Home\nnull id"), (-1, "home"), (300, "Home\n" * 5000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    for small in (False, True):  # small: many chunks and segments, filters of which hashes travel to
        if small:
            monkeypatch.setattr(linedup, "CHUNK", 64)
            monkeypatch.setattr(linedup, "SEGMENT", 16)
        for least, min_chars, keep in ((2, 1, "none"), (10, 1, "none"), (10, 0, "none"), (3, 6, "none"), (2, 1, "first"), (10, 0, "first")):
            got = linedup.dedupe_lines(df, min_docs=least, min_chars=min_chars, keep=keep, filter_bytes=0 if small else linedup.FILTER_BYTES)
            assert order(got.collect()) == order(lines_by_hand(docs, least, min_chars, keep)), (small, least, keep)


def test_only_suspects_leave_their_task(spark):
    """Lines that no other document holds are not shuffled, but for the filter's false positives."""
    df = spark.createDataFrame([(i, f"line {i}\nshared") for i in range(4000)], "id long, text string")
    chunks = linedup._chunks(df.select("text"), 1)
    suspects = linedup._suspects(df, linedup._filters(chunks, 0), 0, 1, linedup.FILTER_BYTES)
    assert 4000 <= suspects.count() <= 4200


def test_bloom_forgets_nothing():
    rng = np.random.default_rng(1)
    held, other = (rng.integers(0, 1 << 63, 20_000).astype(np.uint64) for _ in range(2))
    bloom = linedup.Bloom(1 << 21)
    bloom.add(held)
    table = linedup._Tables([(0, bloom.packed())], 0)
    assert len(bloom.packed()) < len(bloom.bits) // 8
    assert table.has(held).all() and table.has(other).mean() < 0.05


def test_lines_edges(spark, edge, empty):
    assert linedup.dedupe_lines(empty).count() == 0
    got = linedup.dedupe_lines(edge)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"] and got.count() == edge.count()
    assert {(r.n_lines, r.n_dropped) for r in got.where("text = ''").collect()} == {(1, 0)}
    with pytest.raises(ValueError):
        linedup.dedupe_lines(edge, keep="last")


# --- fill-in-middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fim_by_hand(i, text, rate=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return i, text, len(units), "plain", None, None
    if h[3] % 100 < spm:
        return i, f"<S>{s}<P>{p}<M>{m}", len(units), "spm", len(p), len(m)
    return i, f"<P>{p}<S>{s}<M>{m}", len(units), "psm", len(p), len(m)


def test_fim_equals_brute_force_and_comes_back(spark):
    texts = [None, "", " ", "\t\n", "one", " two words", "a<P>b", "<S", "<<S", "x\x00y \x85 z", "\U0010ffff é ß", "ends in space \n\n", "w " * 200_000, "é" * 100_000]
    docs = [(i, texts[i % len(texts)]) for i in range(120)] + [(None, "null id a b c"), (3, "t"), (3, "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for rate in (50, 100):
        got = fim.transform(df, rate=rate).withColumn("back", fim.restored()).collect()
        key = lambda r: (str(r[0]), r[1])
        assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((fim_by_hand(i, t, rate) for i, t in docs), key=key)
        assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in docs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \t\n\x0b<PSM>aé\x85\x00\U0001f600")), max_size=30), min_size=1, max_size=8))
def test_fim_pieces(texts):
    import pyarrow as pa

    draws = [pa.array([hash((t, k)) % 1000 for t in texts], pa.int64()) for k in range(4)]
    output, n, form, p, m = (x.to_pylist() for x in fim.rearranged(pa.array(texts), draws, rate=100))
    for i, t in enumerate(texts):
        assert n[i] == len(UNIT.findall(t))
        assert (form[i] == "plain") == (not t or any(x in t for x in ("<P>", "<S>", "<M>")))
        assert sorted(output[i]) == sorted(t + ("" if form[i] == "plain" else "<P><S><M>"))


def test_fim_edges(spark, edge, empty):
    assert fim.transform(empty).count() == 0
    got = fim.transform(edge)
    assert got.columns == ["doc_id", "output", "n", "form", "prefix_chars", "middle_chars"] and got.count() == edge.count()


# --- vector codes


def codes_by_hand(rows, parts, entries, rounds):
    """{id: (code, error)} and the codebooks of (id, vector) rows, in plain integers."""
    kept = sorted((i, [math.floor(256 * x) for x in v]) for i, v in rows)
    dims = len(kept[0][1]) // parts
    part = lambda v, p: tuple(v[p * dims : (p + 1) * dims])
    books = [[part(v, p) for _, v in kept[:entries]] for p in range(parts)]
    best = lambda x, b: min((sum((c - d) ** 2 for c, d in zip(x, e)), k) for k, e in enumerate(b))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v in kept:
                groups[best(part(v, p), books[p])[1]].append(part(v, p))
            books[p] = [tuple(sum(c) // len(c) for c in zip(*groups[k])) if k in groups else e for k, e in enumerate(books[p])]
    out = {}
    for i, v in kept:
        found = [best(part(v, p), books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found))
    return out, books


@pytest.mark.parametrize(("n", "parts", "dims", "entries", "rounds"), [(300, 4, 3, 7, 3), (40, 2, 1, 64, 1), (1, 3, 2, 5, 2), (200, 1, 6, 200, 2)])
def test_codes_equal_brute_force(spark, n, parts, dims, entries, rounds):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in rng.choice(rng.normal(0, 0.05, 40), parts * dims)]) for i in rng.permutation(n)]
    rows += [(n + i, rows[0][1]) for i in range(60)]  # copies
    df = spark.createDataFrame([(i, v, int(i) % 3) for i, v in rows], "vec_id long, embedding array<float>, label int").repartition(3)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got, books = codes.compress(df, parts=parts, entries=entries, rounds=rounds)
    want, by_hand = codes_by_hand(rows, parts, entries, rounds)
    assert {r.vec_id: (r.code, r.error) for r in got.collect()} == want
    assert [[tuple(e) for e in b.tolist()] for b in books] == by_hand
    for i, v in rows[:20]:
        back = codes.decoded(want[i][0], books)
        assert sum((math.floor(256 * x) - y) ** 2 for x, y in zip(v, back)) == want[i][1]


@pytest.mark.parametrize("nodes", [1, 7, 1 << 13])
def test_trie_equals_all_distances(monkeypatch, nodes):
    monkeypatch.setattr(codes, "NODES", nodes)
    rng = np.random.default_rng(2)
    leaves, entries = np.unique(rng.integers(-4, 4, (800, 4)), axis=0), rng.integers(-4, 4, (30, 4))
    entries[20:] = entries[:10]  # ties go to the lower index
    far = ((leaves[:, None] - entries) ** 2).sum(axis=2)
    index, distance = codes.nearest(leaves, entries)
    assert (index == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()


def test_codes_edges(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    vector = [[0.5] * 16, [0.25] * 16, None, [0.5] * 15 + [None], [nan] + [0.5] * 15, [inf] * 16, [], [0.5] * 15, [0.5] * 32, [1e30] * 16, [-0.0] * 16, [0.5] * 16]
    rows = [(None if i == 11 else i, v, None if i % 2 else 1, "x", 3) for i, v in enumerate(vector)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, code string, error int")
    got, books = codes.compress(df)
    assert [len(b) for b in books] == [5] * 16
    assert sorted((r.vec_id is None, r.vec_id or 0, r.error) for r in got.collect()) == [(False, 0, 0), (False, 1, 0), (False, 9, 0), (False, 10, 0), (True, 0, 0)]
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    out = codes.op13_vector_codes(spark, str(tmp_path))
    assert out.count() == 5 and {r.label_error for r in out.collect()} == {0}
    df.where("false").write.parquet(str(tmp_path / "none/embeddings.parquet"))
    assert codes.op13_vector_codes(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        codes.compress(df, entries=257)
