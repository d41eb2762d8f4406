"""Domain tables over the star-schema tables: findings, scans, projects, groups, observations, history."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.crypto import lookup

NAMES = ("RSA-2048", "AES-256-GCM", "MD5", "SHA-1", "SHA-256", "ECDSA-P256", "3DES", "DES-CBC", "ChaCha20", "RC4", "Ed25519", "DH-2048", "ML-KEM-768", "ML-DSA-65", "HMAC-SHA256", "Blowfish", "AES-128-CBC", "DSA-1024", "ECDH-P384", "SHA-512")
SEVERITIES = ("critical", "high", "medium", "low", "info")
ASSETS = ("algorithm", "protocol", "certificate", "related-crypto-material")
#: Findings of a task, so that what a task sorts does not grow with the table.
ROWS = 500_000
CLASSES = {"AUTOMOBILE": "confidential", "BUILDING": "internal", "FURNITURE": "public", "HOUSEHOLD": "restricted"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    """``n`` rows by a key in parts of some ``ROWS``, or as they are if the cores' parts are no larger. Left alone, Spark joins parts up to 64 MB
    of compressed bytes, which take a multiple of that once they are sorted."""
    parts = math.ceil(n / ROWS)
    return rows.repartition(parts, key) if parts > rows.sparkSession.sparkContext.defaultParallelism else rows


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def rows_of_findings(spark: SparkSession, sf_dir: str) -> int:
    """How many findings there are, from the footers."""
    return table(spark, sf_dir, "lineitem").count()


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = rows_of_findings(spark, sf_dir)
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    # Parts are dealt so that lines come to them in as many parts where they are too large to broadcast; scans come last, as most group by them.
    rows = line.join(dealt(part, "p_partkey", n), line.l_partkey == part.p_partkey)
    rows = dealt(rows, "l_orderkey", n).join(orders, rows.l_orderkey == orders.o_orderkey)
    status = F.when(F.col("l_returnflag") == "R", "resolved").when(F.col("l_returnflag") == "A", "false_positive").when(F.col("l_linestatus") == "F", "in_review").otherwise("open")
    size = F.when(F.col("p_size") <= 10, 1024).when(F.col("p_size") <= 20, 2048).when(F.col("p_size") <= 30, 3072).when(F.col("p_size") <= 40, 4096)
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("finding_id"), F.col("l_orderkey").alias("scan_id"), F.col("o_custkey").alias("project_id"),
        F.col("l_linenumber").alias("seq"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("int").alias("line"),
        F.concat(F.lit("src/"), "p_brand", F.lit("/"), "p_name", F.lit(".py")).alias("file"), _pick(NAMES, F.col("l_suppkey") % 20).alias("name"),
        _pick(SEVERITIES, F.col("l_partkey") % 5).alias("severity"), status.alias("status"), _pick(ASSETS, F.col("l_linenumber") % 4).alias("asset_type"),
        size.alias("key_size"), F.concat(F.lit("r-"), (F.col("l_suppkey") % 20).cast("string")).alias("rule_id"), F.col("l_shipdate").alias("created_at"))


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = lookup(F.col("o_orderstatus"), {"F": "completed", "O": "queued"}, "running")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("scan_id"), F.col("o_custkey").alias("project_id"), status.alias("scan_status"), F.col("o_orderdate").alias("completed_at"))


def projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_nationkey").alias("group_id"), F.col("c_name").alias("project"), lookup(F.col("c_mktsegment"), CLASSES, "internal").alias("classification"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    parent = F.when(F.col("n_nationkey") >= 5, F.floor(F.col("n_nationkey") / 5).cast("int"))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("group_id"), F.col("n_regionkey").cast("int").alias("org_id"), F.col("n_name").alias("group_name"), parent.alias("parent_group_id"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 4
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("project_id"), F.concat(F.lit("svc-"), "event_type").alias("service_name"), _pick(("1.0", "1.1", "1.2", "1.3"), k).alias("tls_version"), F.col("ts").alias("observed_at"))


_CASE = lambda expr, values: "CASE " + expr + "".join(f" WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"

#: The same tables in the oracle's SQL.
SQL = f"""
findings AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS finding_id, l_orderkey AS scan_id, o_custkey AS project_id, l_linenumber AS seq, l_partkey AS part, l_suppkey AS supp,
 CAST(floor(l_quantity) AS INTEGER) AS line, 'src/' || p_brand || '/' || p_name || '.py' AS file, {_CASE('l_suppkey % 20', NAMES)} AS name, {_CASE('l_partkey % 5', SEVERITIES)} AS severity,
 CASE WHEN l_returnflag = 'R' THEN 'resolved' WHEN l_returnflag = 'A' THEN 'false_positive' WHEN l_linestatus = 'F' THEN 'in_review' ELSE 'open' END AS status, {_CASE('l_linenumber % 4', ASSETS)} AS asset_type,
 CASE WHEN p_size <= 10 THEN 1024 WHEN p_size <= 20 THEN 2048 WHEN p_size <= 30 THEN 3072 WHEN p_size <= 40 THEN 4096 END AS key_size, 'r-' || (l_suppkey % 20) AS rule_id, l_shipdate AS created_at
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
scans AS (SELECT o_orderkey AS scan_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'queued' ELSE 'running' END AS scan_status, o_orderdate AS completed_at FROM orders),
projects AS (SELECT c_custkey AS project_id, c_nationkey AS group_id, c_name AS project, CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items())} ELSE 'internal' END AS classification FROM customer),
groups AS (SELECT CAST(n_nationkey AS INTEGER) AS group_id, CAST(n_regionkey AS INTEGER) AS org_id, n_name AS group_name, CASE WHEN n_nationkey >= 5 THEN CAST(n_nationkey // 5 AS INTEGER) END AS parent_group_id FROM nation),
observations AS (SELECT event_id, user_id AS project_id, 'svc-' || event_type AS service_name, {_CASE("CAST(json_extract_string(props, '$.k') AS INTEGER) % 4", ("1.0", "1.1", "1.2", "1.3"))} AS tls_version, ts AS observed_at FROM events)
"""
