"""The pipeline's stages on the smallest documents, each held against its own input."""

from collections import Counter

import corpus_pipeline
from keyloom.llm import decontam, neardup
from tests.llm.test_small import SF, check_pieces, documents


def test_stages(spark, tmp_path):
    docs, seen = documents(spark), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
        if name != "packing":
            assert docs.columns == documents(spark).columns
    before, after = seen["language_id"]
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in before.collect() if r.text and any(c.isalpha() for c in r.text))
    before, after = seen["suffix_dedup"]
    old, new = ({r.doc_id: r.text for r in x.collect()} for x in (before, after))
    assert old.keys() == new.keys()
    seen_words = Counter(tuple(w[i : i + 60]) for w in (t.split() for t in old.values()) for i in range(len(w) - 59))
    for key, text in old.items():
        words = text.split()
        if any(seen_words[tuple(words[i : i + 60])] > 1 for i in range(len(words) - 59) if len(" ".join(words[i : i + 60]).encode()) >= 260):
            assert len(new[key].encode()) <= len(text.encode()) - 240
    assert sum(old[k] == new[k] for k in old) > 0.7 * len(old)
    left = Counter(tuple(w[i : i + 60]) for w in (t.split() for t in new.values()) for i in range(len(w) - 59))
    assert not [w for w, n in left.items() if n > 1 and len(" ".join(w).encode()) >= 260 and seen_words[w] > 1]
    before, after = seen["near_dedup"]
    assert after.count() == neardup.near_duplicates(before).select("class_id").distinct().count()
    before, after = seen["decontamination"]
    assert after.count() == decontam.decontaminate(before, spark.read.parquet(f"{SF}/benchmark.parquet")).where("NOT contaminated").count() < before.count()
    before, rows = seen["packing"]
    check_pieces(rows.collect(), [(r.doc_id, r.text) for r in before.collect()])
