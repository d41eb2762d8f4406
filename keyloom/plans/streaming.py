"""Streaming jobs run over the whole events table with what it holds now, with SQL for their results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.plans.registry import query
from keyloom.sources import adapters as A
from keyloom.streaming import streams


def _folder(spark) -> str:
    """A new path in the cluster's shared folder; a local master without one has a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(?:\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or 'file://' + tempfile.mkdtemp(prefix='keyloom-')).rstrip('/')}/keyloom-stream-{uuid.uuid4().hex}"


def _events(spark, d) -> DataFrame:
    """The events table as a stream: a file source reads folders, so a table in one file is picked from its folder by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/events.parquet")
    reader = spark.readStream.schema(A.table(spark, d, "events").schema)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        rows = reader.parquet(f"{d}/events.parquet")
    else:
        rows = reader.option("pathGlobFilter", "events.parquet").parquet(d)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _observations(spark, d) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int") % 4
    return _events(spark, d).select("event_id", F.col("user_id").alias("project_id"), F.concat(F.lit("svc-"), "event_type").alias("service_name"), A._pick(("1.0", "1.1", "1.2", "1.3"), k).alias("tls_version"), F.col("ts").alias("observed_at"))


def _done(spark, name: str) -> None:
    """Delete a folder that nothing reads again."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _run(spark, stream: DataFrame, mode: str = "append") -> DataFrame:
    folder = _folder(spark)
    streams.run_available(stream, f"{folder}/out", f"{folder}/checkpoint", mode)
    _done(spark, f"{folder}/checkpoint")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out" if mode == "append" else f"{folder}/out/batch=*")


@query(f"WITH {A.SQL} SELECT DISTINCT project_id, service_name, tls_version, CAST(epoch_us(observed_at) AS BIGINT) AS observed_us FROM observations", plain=True)
def stream_ingest(spark, d):
    out = _run(spark, streams.ingest(_observations(spark, d)).select("project_id", "service_name", "tls_version", "observed_at"))
    return out.select("project_id", "service_name", "tls_version", F.unix_micros("observed_at").alias("observed_us"))


@query(f"WITH {A.SQL} SELECT strftime(observed_at, '%Y-%m-%d') AS day, service_name, count(*) AS n, count(*) FILTER (tls_version IN ('1.2', '1.3')) AS compliant FROM observations GROUP BY 1, 2 HAVING CAST(day AS TIMESTAMP) + INTERVAL 1 DAY <= (SELECT max(observed_at) FROM observations) - INTERVAL 1 DAY", plain=True)
def stream_daily(spark, d):
    """The days that the watermark has closed."""
    return _run(spark, streams.daily(_observations(spark, d)))


@query(f"WITH {A.SQL} SELECT project_id, service_name, event_id, tls_version FROM observations QUALIFY row_number() OVER (PARTITION BY project_id, service_name ORDER BY observed_at DESC, event_id DESC) = 1", plain=True)
def stream_latest(spark, d):
    return streams.merge_latest(_run(spark, streams.latest(_observations(spark, d)), "update")).select("project_id", "service_name", "event_id", "tls_version")


@query("SELECT user_id AS scan_id, arg_max(event_id % 101, (ts, event_id % 101)) AS percent FROM events GROUP BY 1", plain=True)
def stream_progress(spark, d):
    out = _run(spark, streams.progress(_events(spark, d).select(F.col("user_id").alias("scan_id"), (F.col("event_id") % 101).alias("percent"), "ts")), "update")
    return out.groupBy("scan_id").agg(F.max(F.struct("ts", "percent")).alias("p")).select("scan_id", "p.percent")


@query("SELECT user_id AS project_id, 'f' || (event_id % 50) AS fingerprint, 'open' AS status FROM events GROUP BY ALL", plain=True)
def stream_lifecycle(spark, d):
    """The findings after the uploads: one state per fingerprint."""
    folder = _folder(spark)
    uploads = _events(spark, d).select(F.col("user_id").alias("project_id"), F.concat(F.lit("f"), (F.col("event_id") % 50).cast("string")).alias("fingerprint")).dropDuplicates()
    streams.lifecycle(uploads, folder).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    last = streams._batches(spark, f"{folder}/findings")[-1]
    _done(spark, f"{folder}/checkpoint")
    _done(spark, f"{folder}/history")
    return spark.read.parquet(f"{folder}/findings/batch={last}").select("project_id", "fingerprint", "status")


@query("SELECT event_id AS rule_id, CAST(epoch_us(ts) AS BIGINT) AS updated_us FROM events WHERE event_type = 'click' AND ts > TIMESTAMP '2024-01-10 00:00:00'", plain=True)
def stream_rule_delta(spark, d):
    folder = _folder(spark)
    rules = _events(spark, d).select(F.col("event_id").alias("rule_id"), F.col("event_type").alias("org_id"), F.col("ts").alias("updated_at"))
    store = lambda batch, i: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={i}")
    streams.rule_delta(rules, "click", "2024-01-10 00:00:00", store).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    _done(spark, f"{folder}/checkpoint")
    return spark.read.schema(rules.schema).parquet(f"{folder}/out/batch=*").select("rule_id", F.unix_micros("updated_at").alias("updated_us"))


@query("""WITH e AS (SELECT DISTINCT user_id AS project_id, date_trunc('day', ts) AS upload, 'f' || (event_id % 50) AS fingerprint FROM events),
u AS (SELECT project_id, upload, row_number() OVER (PARTITION BY project_id ORDER BY upload) AS n FROM (SELECT DISTINCT project_id, upload FROM e)),
p AS (SELECT project_id, fingerprint, n, lag(n) OVER w AS before, lead(n) OVER w AS after FROM e JOIN u USING (project_id, upload) WINDOW w AS (PARTITION BY project_id, fingerprint ORDER BY n)),
c AS (SELECT project_id, fingerprint, n, CASE WHEN before IS NOT NULL THEN 'resolved' END AS old_status, 'open' AS new_status FROM p WHERE before IS NULL OR before < n - 1 UNION ALL SELECT project_id, fingerprint, n + 1, 'open', 'resolved' FROM p WHERE coalesce(after, n + 2) > n + 1)
SELECT project_id, fingerprint, CAST(epoch_us(upload) AS BIGINT) AS upload_us, old_status, new_status, count(*) FILTER (old_status = 'resolved') OVER (PARTITION BY project_id, fingerprint ORDER BY n) AS reopen_count FROM c JOIN u USING (project_id, n)""", plain=True)
def stream_lifecycle_history(spark, d):
    """Every change of a finding over the uploads of its project, one upload a day, from keyed state."""
    e = _events(spark, d).select(F.col("user_id").alias("project_id"), F.date_trunc("day", "ts").alias("upload"), F.concat(F.lit("f"), (F.col("event_id") % 50).cast("string")).alias("own"))
    uploads = e.select("project_id", "upload", F.explode(F.array("own", F.lit(None))).alias("fingerprint"))
    out = _run(spark, streams.lifecycle_changes(uploads))
    return out.select("project_id", "fingerprint", F.unix_micros("upload").alias("upload_us"), "old_status", "new_status", F.col("reopen_count").cast("long").alias("reopen_count"))
