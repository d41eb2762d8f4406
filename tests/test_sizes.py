"""Operators that join, sort and write less: plans and rows of small tables."""

import re

from pyspark.sql import functions as F

from keyloom.operators import drift, portal, rules
from keyloom.plans import code as plans
from keyloom.plans import portal as _portal, registry, rollups  # noqa: F401
from keyloom.sources import adapters as A
from keyloom.sources import documents as D

SF = "/root/testdata/sf0.001"

OBSERVED = "project_id int, cipher_suite string, tls_version string, event_id int, service_name string, observed_at int"
FOUND = "finding_id string, project_id int, name string, service_name string, configured_tls string"


def said(df):
    """The plan's text before it runs."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")


def test_runtime_joins_findings_once(spark):
    seen = [(1, "RC4", "1.0", 5, "a", 5), (1, "", "1.2", 3, "a", 9), (1, None, None, 1, None, 1), (2, "KYBER", "1.3", 7, "b", 7), (2, "aes", None, 8, "b", 6)]
    found = [("f1", 1, "rc4 over TLS 1.2", "b", "1.3"), ("f2", 1, "rc4", "a", None), ("f3", 1, None, "a", "1.0"), ("f4", 2, "AES", "b", "1.3"), ("f5", 3, "rc4", "a", "1.2"), ("f6", None, "rc4", "a", "1.2")]
    f = spark.createDataFrame(found, FOUND).repartition(2)
    out = portal.enrich_runtime(f, spark.createDataFrame(seen, OBSERVED))
    assert said(out).count("RoundRobinPartitioning") == 1
    got = {r.finding_id: tuple(r)[1:] for r in out.collect()}
    assert got == {"f1": (True, "1.2", "", True), "f2": (True, "1.0", "RC4", False), "f3": (True, "1.2", "", True), "f4": (True, None, "aes", False), "f5": (False, None, None, False), "f6": (False, None, None, False)}


def test_agility_makes_one_row_a_finding(spark):
    rows = [(1, "a", "MD5"), (1, "a", "AES"), (1, "b", "AES"), (1, None, "none such"), (2, "a", None)]
    f = spark.createDataFrame(rows, "project_id int, file string, name string").withColumns({"is_wrapper": F.lit(True), "call_depth": F.lit(0), "key_management": F.lit("kms")})
    out = portal.agility(f)
    assert {r.project_id: (r.concentration, r.diversity, r.readiness) for r in out.collect()} == {1: (100.0, 100.0, 50.0), 2: (100.0, 100.0, 100.0)}
    assert "Expand" not in said(out)


def test_properties_are_mapped_after_the_last_row_is_taken(spark):
    rows = [("k", 1, "x"), ("k", 2, "y"), ("n", None, "z")]
    df = spark.createDataFrame(rows, "ref string, at int, v string").select("ref", "at", F.struct("v").alias("crypto"))
    out = drift.diff_properties(df, df.where("at = 1"), ["ref"], ["crypto"], "at")
    assert {r.ref: (r.change, [tuple(c) for c in r.changes]) for r in out.collect()}["k"] == ("changed", [("crypto.v", "y", "x")])
    aggregates = [line for line in said(out).splitlines() if "max_by" in line]
    assert aggregates and not any("map" in line for line in aggregates)


def test_rule_scan_makes_rows_of_needed_words_only(spark):
    files = spark.createDataFrame([("a.py", "many other words stand here\nx = hashlib.md5(many, words)")], "path string, content string")
    out = rules.scan_rules(files, rules.compile_rules(plans.PACK)[0])
    assert [(r.line, r.rule_id) for r in out.collect()] == [(2, "own-py-md5-or-sha1")]
    made = [line for line in said(out).splitlines() if "Generate explode" in line and "regexp_extract_all" in line]
    assert made and all("INSET" in line or " IN (" in line for line in made)
    assert rules.scan_rules(files, []).count() == 0


def widths(spark, name, monkeypatch):
    """Partitions by key of the shuffles of a query where parts are too large to broadcast and findings make 30 parts of 200."""
    monkeypatch.setattr(A, "ROWS", 200)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return [(re.sub(r"#\d+L?", "", keys), int(n)) for keys, n in re.findall(r"Exchange hashpartitioning\((.+), (\d+)\)", said(registry.QUERIES[name](spark, SF)))]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_report_bundle_meets_parts_and_scans_in_bounded_parts(spark, monkeypatch):
    assert set(widths(spark, "portfolio_report_bundle", monkeypatch)) == {("l_partkey", 30), ("p_partkey", 30), ("l_orderkey", 30), ("o_orderkey", 30), ("scan_id", 30)}


def test_scan_metrics_group_without_a_further_shuffle(spark, monkeypatch):
    assert set(widths(spark, "portfolio_scan_metrics", monkeypatch)) == {("l_partkey", 30), ("p_partkey", 30), ("l_orderkey", 30), ("o_orderkey", 30), ("scan_id", 30)}


def test_baseline_is_met_in_bounded_parts(spark, monkeypatch):
    found = widths(spark, "drift_baseline_kept", monkeypatch)
    assert [(k, n) for k, n in found if n < 30] == [("fingerprint", 4)]  # the entries, summed before they are shuffled
    assert found.count(("fingerprint", 30)) == 2


def test_rule_window_meets_its_history_in_bounded_parts(spark, monkeypatch):
    assert {(k, n) for k, n in widths(spark, "portfolio_rule_window", monkeypatch) if n < 30} == {("rule_id", 4)}  # twenty rules


def test_sarif_leaves_findings_where_their_scan_is(spark, monkeypatch):
    assert {k for k, _ in widths(spark, "portfolio_sarif", monkeypatch)} == {"l_partkey", "p_partkey", "l_orderkey", "o_orderkey"}
    rows = [(1, 2, "b", "x", "high"), (1, 1, "c", "y", "low"), (1, 3, "a", "y", "low"), (1, 4, "d", None, "info"), (2, 1, "e", "x", "medium")]
    out = D.sarif_results(spark.createDataFrame(rows, "scan_id int, seq int, finding_id string, rule_id string, severity string"))
    assert {r.finding_id: r.rule_index for r in out.collect()} == {"c": 0, "a": 0, "b": 1, "d": 2, "e": 0}
