"""Structured Streaming jobs over runtime observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.drift import match_findings
from keyloom.operators.links import fan_out

KEYS = ["project_id", "service_name", "tls_version", "observed_at"]


def ingest(observations: DataFrame, late: str = "1 hour") -> DataFrame:
    """Observations without the repeats that arrive within the watermark."""
    return observations.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(KEYS)


def daily(observations: DataFrame, late: str = "1 day") -> DataFrame:
    """Observations and modern ones per day and service."""
    rows = observations.withWatermark("observed_at", late).groupBy(F.window("observed_at", "1 day").alias("w"), "service_name")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("tls_version").isin("1.2", "1.3")).alias("compliant")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "service_name", "n", "compliant")


def latest(observations: DataFrame, late: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Latest TLS version per service and span of event time, in update mode. A span's state ends with the watermark, so
    what is kept doesn't grow with time; :func:`merge_latest` joins the spans."""
    rows = observations.withWatermark("observed_at", late).groupBy(F.window("observed_at", span), "project_id", "service_name")
    newest = F.max(F.struct("observed_at", "event_id", "tls_version")).alias("o")
    return rows.agg(newest).select("project_id", "service_name", "o.observed_at", "o.event_id", "o.tls_version")


def merge_latest(states: DataFrame) -> DataFrame:
    """One row per service: the newest of all its spans."""
    newest = F.max(F.struct("observed_at", "event_id", "tls_version")).alias("o")
    return states.groupBy("project_id", "service_name").agg(newest).select("project_id", "service_name", "o.observed_at", "o.event_id", "o.tls_version")


def alerts(events: DataFrame, prefs: DataFrame) -> DataFrame:
    """In-app messages of a stream of events, by the users' stored preferences."""
    return fan_out(events, prefs)


def progress(messages: DataFrame, late: str = "1 hour", span: str = "1 day") -> DataFrame:
    """Latest progress of every scan and span of event time, in update mode; a span's state ends with the watermark."""
    rows = messages.withWatermark("ts", late).groupBy(F.window("ts", span), "scan_id")
    return rows.agg(F.max(F.struct("ts", "percent")).alias("p")).select("scan_id", "p.ts", "p.percent")


def _batches(spark, path: str) -> list[int]:
    """Numbers of the batches whose results lie under a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


def lifecycle(uploads: DataFrame, folder: str):
    """Writer that matches every batch of an upload stream with the findings of the batch before and keeps, by batch number,
    the findings (``findings/batch=N``) and the changes of state (``history/batch=N``). A batch that runs again reads the same
    findings and replaces what it wrote."""

    def match(batch: DataFrame, i: int) -> None:
        spark = batch.sparkSession
        before = [n for n in _batches(spark, f"{folder}/findings") if n < i]
        schema = "project_id long, fingerprint string, status string, reopen_count int"
        existing = spark.read.schema(schema).parquet(f"{folder}/findings/batch={before[-1]}") if before else spark.createDataFrame([], schema)
        found = match_findings(existing, batch.select("project_id", "fingerprint"))
        changes = found.join(existing.select("project_id", "fingerprint", F.col("status").alias("old_status")), ["project_id", "fingerprint"], "left").where("NOT next_status <=> old_status")
        changes.select("project_id", "fingerprint", "old_status", F.col("next_status").alias("new_status")).write.mode("overwrite").parquet(f"{folder}/history/batch={i}")
        found.select("project_id", "fingerprint", F.col("next_status").alias("status"), F.col("reopen_count").cast("int").alias("reopen_count")).write.mode("overwrite").parquet(f"{folder}/findings/batch={i}")

    return uploads.writeStream.foreachBatch(match)


#: What the state of a project's share holds, and the changes that it emits.
_STATE = "upload long, fingerprints array<string>, open array<boolean>, reopened array<int>"
_CHANGE = "project_id long, fingerprint string, upload timestamp, old_status string, new_status string, reopen_count int"


def apply_uploads(known: dict[str, list], last: int, uploads: dict[int, set]) -> tuple[int, list[tuple]]:
    """The time of the last upload and the changes (fingerprint, time, old and new status, times reopened) after ``uploads`` (time: fingerprints), in
    their order. ``known`` (fingerprint: open, times reopened) is brought up to date; a frame is made once a key, not once an upload."""
    out = []
    for us in sorted(uploads):
        present = uploads[us]
        if us <= last:
            out += [(n, us, None, "late", 0) for n in sorted(present)]
            continue
        last = us
        for n, (o, r) in known.items():
            if o and n not in present:
                known[n] = [False, r]
                out.append((n, us, "open", "resolved", r))
        for n in sorted(present):
            if n not in known:
                known[n] = [True, 0]
                out.append((n, us, None, "open", 0))
            elif not known[n][0]:
                known[n] = [True, known[n][1] + 1]
                out.append((n, us, "resolved", "open", known[n][1]))
    return last, out


def lifecycle_changes(uploads: DataFrame, late: str = "1 day", keep_days: int = 365, buckets: int = 4) -> DataFrame:
    """Changes of state of findings, from a stream of uploads (project_id, upload, fingerprint; ``upload`` is its time, and a null fingerprint
    says that it happened, which every upload needs once). A finding that an upload lacks is resolved, one that comes back reopens.

    State is kept by project and ``buckets`` shares of its fingerprints: a batch touches the projects it holds and nothing else, and a large project
    is dealt over tasks; every share hears of every upload. The uploads of a batch are taken in their order. Rows of an upload come in
    one batch; those of one that is no newer than the last change nothing and are emitted with ``new_status`` "late", or, behind the watermark,
    left out and counted (:func:`dropped_rows`). The state of
    a project without an upload for ``keep_days`` behind the watermark goes."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    share = F.pmod(F.xxhash64("fingerprint"), F.lit(buckets)).cast("int")
    shares = F.when(F.col("fingerprint").isNull(), F.array(*map(F.lit, range(buckets)))).otherwise(F.array(share))
    rows = uploads.select(F.col("project_id").cast("long"), F.col("upload").cast("timestamp"), "fingerprint").withWatermark("upload", late).withColumn("share", F.explode(shares))

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        last, names, is_open, reopened = state.get if state.exists else (-(1 << 62), [], [], [])
        known = {n: [o, r] for n, o, r in zip(names, is_open, reopened)}
        batch: dict[int, set] = {}
        for frame in frames:
            for us, name in zip(frame["upload"].to_numpy().astype("datetime64[us]").astype("int64").tolist(), frame["fingerprint"].tolist()):
                own = batch.setdefault(us, set())
                if isinstance(name, str):
                    own.add(name)
        last, out = apply_uploads(known, last, batch)
        state.update((last, list(known), [o for o, _ in known.values()], [r for _, r in known.values()]))
        state.setTimeoutTimestamp(max(last // 1000 + keep_days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        if out:
            name, us, old, new, count = zip(*out)
            yield pd.DataFrame({"project_id": np.full(len(out), key[0]), "fingerprint": name, "upload": np.array(us, "datetime64[us]"), "old_status": old, "new_status": new, "reopen_count": np.array(count, "int32")})

    return rows.groupBy("project_id", "share").applyInPandasWithState(step, _CHANGE, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def rule_delta(rules: DataFrame, org_id, since, store):
    """Writer of an organisation's rules that changed after ``since``, oldest first in a batch; its checkpoint knows what was sent."""
    changed = rules.where((F.col("org_id") == F.lit(org_id)) & (F.col("updated_at") > F.lit(since)))
    return changed.writeStream.foreachBatch(lambda batch, i: store(batch.orderBy("updated_at", "rule_id"), i))


def dropped_rows(query) -> int:
    """Rows that came behind the watermark so far and were left out, of a query that has run."""
    return sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])


def state_rows(query) -> int:
    """Keys in the query's state after its last batch with one."""
    return next((sum(int(op["numRowsTotal"]) for op in p["stateOperators"]) for p in reversed(query.recentProgress) if p["stateOperators"]), 0)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process what there is and stop; returns the query, for :func:`dropped_rows` and :func:`state_rows`. Modes that a file sink lacks write each batch into a folder of its own."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", path)
    else:
        writer = writer.foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/batch={i}"))
    query = writer.start()
    query.awaitTermination()
    return query
