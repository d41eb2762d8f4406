"""Scratch tables: what a computation wrote on its way goes, its result stays."""

import os

from keyloom.llm.common import settled, written


def test_settled_keeps_only_the_result(spark):
    seen = []

    def inner():
        seen.append(written(spark.range(3), "inner"))
        return seen[-1].where("id > 0")

    def outer():
        seen.append(settled(inner, "middle"))
        return seen[-1].where("id > 1")

    out = settled(outer, "outer")
    local = lambda df: os.path.exists(df._keyloom_path.removeprefix("file://"))
    assert [r.id for r in out.collect()] == [2] and local(out)
    assert not any(map(local, seen))
