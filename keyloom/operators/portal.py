"""Lists, trackers and roll-ups that a portal asks for: paging, runtime enrichment, certificates, trends, requests, scopes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyloom.functions import crypto as X
from keyloom.operators import code


def newest_first(rows: DataFrame, time: str, key: str) -> DataFrame:
    return rows.orderBy(F.desc(time), key)


def paginate(rows: DataFrame, order: list, page: int, per_page: int = 25) -> DataFrame:
    """A 1-based page in a total order, with ``total`` rows over all pages. The order must end in a unique key."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((page - 1) * per_page).limit(per_page).crossJoin(total)


def list_assets(findings: DataFrame, projects: DataFrame, name: str | None = None, asset_type: str | None = None, posture: str | None = None, language: str | None = None) -> DataFrame:
    """Findings with their project, filtered by any of a part of the name, type, posture and language."""
    from keyloom.operators.detect import language as language_of
    from keyloom.operators.portfolio import with_posture

    rows = with_posture(findings).withColumn("language", language_of(F.col("file")))
    for column, value in (("asset_type", asset_type), ("posture", posture), ("language", language)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows if name is None else rows.where(F.contains(F.lower("name"), F.lit(name.lower())))
    return rows.join(projects.select("project_id", "project"), "project_id")


def query_audit_log(events: DataFrame, start: str, end: str, n: int = 100, **equal) -> DataFrame:
    """Newest events of a half-open time range with the stated values."""
    rows = events.where((F.col("ts") >= F.lit(start).cast("timestamp")) & (F.col("ts") < F.lit(end).cast("timestamp")))
    for column, value in equal.items():
        rows = rows.where(F.col(column) == value)
    return newest_first(rows, "ts", "event_id").limit(n)


def accessible_projects(users: DataFrame, projects: DataFrame, groups: DataFrame, descent: DataFrame, slices: int = 16) -> DataFrame:
    """(user_id, project_id): org scope sees all projects of the org, group scope those of the group's subtree (``descent``:
    root, group_id), project scope the one named; any other scope none.

    Grants are made distinct by user and place, a place being all the groups of a project, so that the pairs need no comparing with each
    other, and the pairs of a place are made in ``slices`` parts, more where a part would have over ``PAIRS``. Users and projects of a place meet as blocks of ``BLOCK`` at most: the pairs of two
    blocks come user by user with the same projects again, which files hold in a few bits a pair."""
    placed = projects.select("project_id", "group_id").join(groups.select("group_id", "org_id").distinct(), "group_id")
    placed = placed.groupBy("project_id").agg(F.array_sort(F.collect_set(F.struct("group_id", "org_id"))).alias("place"))
    inside = placed.select("place").distinct().select("place", F.inline("place"))
    by_org = users.where("scope = 'org'").select("user_id", F.col("scope_id").alias("org_id")).distinct().join(inside, "org_id")
    below = users.where("scope = 'group'").select("user_id", F.col("scope_id").alias("root")).distinct().join(descent, "root").select("user_id", "group_id").join(inside, "group_id")
    grants = by_org.select("user_id", "place").unionByName(below.select("user_id", "place")).distinct()
    by_project = users.where("scope = 'project'").select("user_id", F.col("scope_id").alias("project_id")).distinct().join(placed, "project_id")
    alone = by_project.join(grants, ["user_id", "place"], "left_anti").select("user_id", "project_id")
    per = grants.groupBy("place").agg(F.count("*").alias("m")).join(placed.groupBy("place").agg(F.count("*").alias("n")), "place").agg(F.sum(F.col("m") * F.col("n")).alias("all"), F.max(F.col("m") * F.col("n")).alias("most")).first()
    slices = max(slices, math.ceil((per.most or 0) / PAIRS))
    parts = max(int(users.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((per.all or 0) / PAIRS))  # by number, since few bytes of input make many pairs
    dealt = _in_blocks(grants, "user_id").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(parts, "place", "slice")
    sliced = _in_blocks(placed, "project_id").withColumn("slice", F.pmod("block", F.lit(slices)).cast("int")).repartition(parts, "place", "slice")
    pairs = sliced.drop("block").join(dealt.drop("block"), ["place", "slice"]).select(F.explode("user_ids").alias("user_id"), "project_ids")
    return pairs.select("user_id", F.explode("project_ids").alias("project_id")).unionByName(alone)


#: Users, or projects, of a place that meet at once. Parquet packs 504 values in a run, so that runs of the same projects are the same bytes.
BLOCK = 504
#: Pairs of a part: a task that writes holds what it encoded until its row group ends, and these are small on disk.
PAIRS = 20_000_000


def _in_blocks(rows: DataFrame, key: str) -> DataFrame:
    """(place, block, ``key`` and s): the keys of every place as arrays of ``BLOCK`` or fewer, cut from heaps of some 16 times that; blocks are counted on."""
    heaps = rows.groupBy("place").agg(F.ceil(F.count("*") / (16 * BLOCK)).alias("heaps"))
    heap = F.pmod(F.xxhash64(key), F.col("heaps")).alias("heap")
    whole = rows.join(heaps, "place").groupBy("place", heap).agg(F.collect_list(F.struct(key)).alias("whole"))
    starts = F.sequence(F.lit(1), F.size("whole"), F.lit(BLOCK))  # the list is of structs, as lists of values drop nulls
    cut = whole.select("place", "heap", F.posexplode(F.transform(starts, lambda at: F.slice(f"whole.{key}", at, BLOCK))).alias("pos", f"{key}s"))
    return cut.select("place", (F.col("heap") * 16 + F.col("pos")).alias("block"), f"{key}s")


def descendants(groups: DataFrame) -> DataFrame:
    """(root, group_id) of every group and those below it, a level a step; the depth of a hierarchy is small."""
    step = groups.select(F.col("group_id").alias("root"), "group_id")
    child = groups.where("parent_group_id IS NOT NULL").select(F.col("parent_group_id").alias("above"), F.col("group_id").alias("below"))
    out = step
    for _ in range(64):
        step = step.join(child, F.col("group_id") == F.col("above")).select("root", F.col("below").alias("group_id"))
        if step.isEmpty():
            return out
        out = out.unionByName(step)
    raise ValueError("groups are nested in a circle")


#: Policy rules and parts of the rule ids that violate them.
VIOLATIONS = {
    "no-broken-algorithms": ("md5", "sha1", "sha-1", "des", "rc4", "rc2", "broken"), "no-ecb-mode": ("ecb",), "rsa-min-key-size": ("rsa",),
    "no-deprecated-tls": ("tls-1.0", "tls-1.1", "deprecated-tls", "tls1_0", "tls1_1"), "quantum-vulnerable": ("quantum",), "no-hardcoded-keys": ("hardcoded-key", "hardcoded_key", "hardcoded"),
}


def violation_counts(findings: DataFrame) -> DataFrame:
    """Findings whose rule id holds one of a policy rule's parts, a row for every policy rule."""
    low = F.lower("rule_id")
    hits = lambda parts: F.greatest(*(low.contains(p) for p in parts), F.lit(False))
    one = findings.agg(*(F.count_if(hits(parts)).alias(rule) for rule, parts in VIOLATIONS.items()))
    return one.select(F.inline(F.array(*(F.struct(F.lit(r).alias("policy_rule"), F.col(f"`{r}`").alias("violations")) for r in VIOLATIONS))))


def enrich_runtime(findings: DataFrame, observations: DataFrame) -> DataFrame:
    """What runs, beside what is configured: the project's first observation whose cipher is in the finding's name or whose
    version it names, else the latest of the finding's service; ``mismatch`` where the configured version differs.

    Observations are first reduced to one row a project, cipher and version, and to one a project and service; a project's rows of both
    kinds then meet its findings as two arrays, so that findings are joined once."""
    kinds = observations.groupBy("project_id", "cipher_suite", "tls_version").agg(F.min("event_id").alias("nth")).where("nth IS NOT NULL")
    kind = F.struct("nth", "tls_version", "cipher_suite", F.upper("cipher_suite").alias("cipher"), F.concat(F.lit("tls "), "tls_version").alias("version"))
    kinds = kinds.groupBy("project_id").agg(F.array_sort(F.collect_list(kind)).alias("kinds"))
    latest = observations.groupBy("project_id", "service_name").agg(F.max_by(F.struct("tls_version", "cipher_suite"), F.struct("observed_at", "event_id")).alias("o"))
    latest = latest.groupBy("project_id").agg(F.collect_list(F.struct("service_name", "o")).alias("services"))

    def said(k: Column, name: Column) -> Column:
        cipher = (k["cipher"] != "") & F.contains(name["upper"], k["cipher"])
        version = (k["tls_version"] != "") & F.contains(name["lower"], k["version"])
        return F.coalesce(cipher, F.lit(False)) | F.coalesce(version, F.lit(False))

    names = F.struct(F.upper("name").alias("upper"), F.lower("name").alias("lower"))
    first = X.once(names, lambda name: F.get(F.filter("kinds", lambda k: said(k, name)), F.lit(0)))
    by_name = X.once(first, lambda k: F.when(k.isNotNull(), F.struct(k["tls_version"].alias("tls_version"), k["cipher_suite"].alias("cipher_suite"))))
    by_service = F.get(F.filter("services", lambda s: s["service_name"] == F.col("service_name")), F.lit(0))["o"]
    out = findings.join(kinds, "project_id", "left").join(latest, "project_id", "left").withColumn("o", F.coalesce(by_name, by_service))
    differs = (F.coalesce("configured_tls", F.lit("")) != "") & (F.coalesce("o.tls_version", F.lit("")) != "") & (F.col("configured_tls") != F.col("o.tls_version"))
    return out.select("finding_id", F.col("o").isNotNull().alias("runtime_observed"), F.col("o.tls_version").alias("observed_tls_version"), F.col("o.cipher_suite").alias("observed_cipher"), F.coalesce(differs, F.lit(False)).alias("mismatch"))


def certificate_tracker(certificates: DataFrame, now: Column) -> DataFrame:
    """``days_remaining`` (whole days, floored) and a colour for every certificate with a readable end; text ends count too."""
    end = F.col("not_after") if certificates.schema["not_after"].dataType.simpleString() != "string" else F.try_to_timestamp("not_after")
    days = F.floor((F.unix_timestamp(end) - F.unix_timestamp(now)) / 86400).cast("int")
    colour = F.when(days < 0, "black").when(days < 30, "red").when(days <= 90, "amber").otherwise("green")
    return certificates.where(end.isNotNull()).withColumns({"days_remaining": days, "status_color": colour})


def certificate_graph(certificates: DataFrame) -> DataFrame:
    """Distinct dependency edges (ref, depends_on): a certificate on its signature algorithm and key, a key on its algorithm if it
    has one. Algorithms are shared, so equal ones are one node."""
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    edge = lambda a, b: F.struct(a.alias("ref"), b.alias("depends_on"))
    keyed = F.coalesce("key_algorithm", F.lit("")) != ""
    edges = F.array_compact(F.array(F.when(F.col("signature") != "", edge(node("cert", "cert_id"), node("alg", "signature"))), F.when(keyed, edge(node("cert", "cert_id"), node("key", "cert_id"))), F.when(keyed, edge(node("key", "cert_id"), node("alg", "key_algorithm")))))
    return certificates.select(F.inline(edges)).distinct()


def daily_compliance(scores: DataFrame) -> DataFrame:
    """Mean score and sums of each day, framework and project."""
    return scores.groupBy(F.to_date("time").alias("day"), "framework", "project_id").agg(X.mean_score(F.col("score")).alias("avg_score"), F.sum("compliant").alias("compliant"), F.sum("non_compliant").alias("non_compliant"))


def compliance_trend(daily: DataFrame, framework: str, period: str, now: str, project_id=None) -> DataFrame:
    """The days of the last ``Nd`` (30 if it can't be read), oldest first; a row for each project unless one is named."""
    period = period.strip().lower()
    days = int(period[:-1]) if period.endswith("d") and period[:-1].lstrip("+-").isdigit() else 30
    rows = daily.where((F.col("framework") == framework) & (F.col("day") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")))
    rows = rows if project_id is None else rows.where(F.col("project_id") == project_id)
    return rows.select("day", "project_id", F.bround("avg_score", 1).alias("score"), "compliant", "non_compliant").orderBy("day", "project_id")


def scan_metrics(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Counts, quantum risk and compliance of every completed scan with findings, by time and project."""
    from keyloom.operators.rollups import report_bundle

    rows = report_bundle(findings, scans).where("findings > 0")
    return rows.select("completed_at", "project_id", "scan_id", "findings", F.col("n_critical").alias("critical"), F.col("n_high").alias("high"), "quantum_risk", F.col("nist_score").alias("compliance"))


def scan_queue(scans: DataFrame, status: str | None = None, project_id=None) -> DataFrame:
    """Scans by state and project with their duration in whole seconds (null while one end is missing)."""
    rows = scans if status is None else scans.where(F.col("scan_status") == status)
    rows = rows if project_id is None else rows.where(F.col("project_id") == project_id)
    return rows.withColumn("duration", F.unix_timestamp("completed_at") - F.unix_timestamp("started_at"))


REVIEWERS, REQUESTED = ("org_admin", "security_manager", "security_engineer"), ("false_positive", "risk_accepted")


def apply_request_decisions(requests: DataFrame, decisions: DataFrame, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcome of every decision (request_id, decision, error, status) and the findings' new states with their history
    (finding_id, old_status, new_status, reason). Only pending requests are decided, only by reviewers, and nobody approves an own one."""
    rows = decisions.join(requests, "request_id", "left")
    error = (F.when(F.col("request_status").isNull(), "unknown request").when(F.col("request_status") != "pending", F.concat(F.lit("already "), "request_status"))
             .when((F.col("decision") == "approve") & (F.col("requested_by") == F.col("actor")), "own request").when(~F.col("role").isin(*REVIEWERS), F.concat(F.lit("role "), "role")))
    state = F.when(error.isNotNull(), F.col("request_status")).when(F.col("decision") == "approve", "approved").otherwise("rejected")
    outcome = rows.withColumns({"error": error, "status": state})
    changed = outcome.where((F.col("error").isNull()) & (F.col("decision") == "approve") & F.col("request_type").isin(*REQUESTED)).select("finding_id", F.col("request_type").alias("new_status"))
    history = changed.join(findings.select("finding_id", F.col("status").alias("old_status")), "finding_id")
    return outcome.select("request_id", "decision", "error", "status"), history.select("finding_id", "old_status", "new_status", F.concat(F.lit("Approved "), "new_status", F.lit(" request")).alias("reason"))


def over_scoped(keys: DataFrame, roles: DataFrame) -> DataFrame:
    """Keys that hold scopes which their role doesn't allow, with those scopes in order."""
    extra = F.array_sort(F.array_except("scopes", F.coalesce("allowed", F.array().cast("array<string>"))))
    return keys.join(roles, "role", "left").withColumn("extra", extra).where(F.size("extra") > 0).drop("allowed")


def list_rules(rules: DataFrame, category: str | None = None, maturity: str | None = None, enabled: bool | None = None) -> DataFrame:
    for column, value in (("category", category), ("maturity", maturity), ("default_enabled", enabled)):
        rules = rules if value is None else rules.where(F.col(column) == value)
    return rules


def scan_numbers(scans: DataFrame, newest: int = 50) -> DataFrame:
    """The newest completed scans of each project, numbered downwards from how many the list holds."""
    by = W.partitionBy("project_id").orderBy(F.desc("completed_at"), F.desc("scan_id"))
    rows = scans.where("scan_status = 'completed'").withColumn("place", F.row_number().over(by)).where(F.col("place") <= newest)
    return rows.withColumn("number", F.count("*").over(W.partitionBy("project_id")) - F.col("place") + 1).drop("place")


def number_findings(findings: DataFrame) -> DataFrame:
    """``FIND-n`` within each scan, by file, line and rule."""
    by = W.partitionBy("scan_id").orderBy("file", "line", "rule_id", "finding_id")
    return findings.withColumn("number", F.concat(F.lit("FIND-"), F.row_number().over(by).cast("string")))


def dedupe_scan_requests(requests: DataFrame, now: Column, patience: int = 600) -> DataFrame:
    """Requests with the scan that answers them: the first waiting or running one of the same project and commit; a request that
    has waited longer than ``patience`` seconds has failed and answers none."""
    late = (F.col("state") == "queued") & (F.unix_timestamp(now) - F.unix_timestamp("created_at") > patience)
    rows = requests.withColumn("state", F.when(late, "failed").otherwise(F.col("state")))
    live = rows.where("state IN ('queued', 'running')").groupBy("project_id", "commit").agg(F.min_by("request_id", F.struct("created_at", "request_id")).alias("existing"))
    answer = F.when(F.col("state").isin("queued", "running"), F.col("existing"))
    return rows.join(live, ["project_id", "commit"], "left").withColumn("answer", answer).drop("existing")


def resolve_library(findings: DataFrame, manifests: DataFrame) -> DataFrame:
    """Findings with version and purl of their library from the nearest manifest above their file; ``pass`` 3 rows have none.
    ``manifests``: library, dir (ends in a slash, empty for the root), version, purl."""
    hinted = findings.where("pass <> 3 AND library IS NOT NULL").select("finding_id", "library", "file").join(manifests, "library").where(F.col("file").startswith(F.col("dir")))
    best = hinted.groupBy("finding_id").agg(F.max_by(F.struct("version", "purl"), F.struct(F.length("dir"), "version", "purl")).alias("m"))
    return findings.join(best, "finding_id", "left").select(*(findings[c] for c in findings.columns), F.col("m.version").alias("library_version"), F.col("m.purl").alias("purl"))


def stamp_layers(findings: DataFrame, layers: DataFrame) -> DataFrame:
    """The image layer (``digest``) of each finding's file, where known, in front of its path; package databases are flagged."""
    metadata = F.col("file").rlike(r"(?:^|/)(?:var/lib/dpkg|lib/apk/db|var/lib/rpm|etc/os-release)(?:/|$)")
    rows = findings.join(layers, "file", "left")
    return rows.withColumns({"location": F.when(F.col("digest").isNull(), F.col("file")).otherwise(F.concat_ws("!/", "digest", "file")), "metadata": metadata})


def import_gate(findings: DataFrame, imports: DataFrame) -> DataFrame:
    """Findings of files that import what their rule asks for; rules that ask for nothing pass."""
    free = findings.where("needs IS NULL")
    return free.unionByName(findings.where("needs IS NOT NULL").join(imports.select("file", F.col("module").alias("needs")), ["file", "needs"], "left_semi").select(*findings.columns))


def assign_then_use(assignments: DataFrame, uses: DataFrame) -> DataFrame:
    """Each use of a variable with the literal last assigned to it on an earlier line of its file."""
    return code.as_of(assignments, uses).where("value IS NOT NULL").withColumnRenamed("line", "use_line")


def normalization_tally(rows: DataFrame, allowed: dict[str, tuple[str, ...]], examples: int = 10) -> DataFrame:
    """How often each field holds a value that its vocabulary lacks, with the first such rows by ``finding_id``."""
    misses = F.array_compact(F.array(*(F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.struct(F.lit(c).alias("field"), F.col(c).alias("value"))) for c, values in allowed.items())))
    found = rows.select("finding_id", F.inline(misses))
    ranked = found.withColumn("nth", F.row_number().over(W.partitionBy("field").orderBy("finding_id"))).where(F.col("nth") <= examples)
    first = ranked.groupBy("field").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "finding_id"))), lambda x: x.finding_id), ",").alias("examples"))
    return found.groupBy("field").agg(F.count("*").alias("n")).join(first, "field")


def agility(findings: DataFrame) -> DataFrame:
    """Five step scores of each project and their weighted sum. ``is_wrapper`` or a ``call_depth`` above one counts as wrapped;
    ``key_management`` says where keys are kept."""
    from keyloom.operators.portfolio import step, with_family

    kept = lambda *names: F.count_if(F.lower("key_management").isin(*names))
    known = F.col("family") != "unknown"
    wrapped = F.coalesce("is_wrapper", F.lit(False)) | (F.coalesce("call_depth", F.lit(0)) > 1)
    bit = {f: 1 << k for k, f in enumerate(dict.fromkeys(f for _, f in X.FAMILY_FULL))}  # families are few and fixed: only files are counted as distinct rows
    by = with_family(findings).groupBy("project_id").agg(
        F.count("*").alias("calls"), F.countDistinct("file").alias("files"), F.count_if(wrapped).alias("wrapped"), F.bit_count(F.coalesce(F.bit_or(X.lookup(F.col("family"), bit, 0)), F.lit(0))).cast("long").alias("algorithms"),
        kept("kms", "hsm", "vault").alias("kms"), kept("hardcoded", "embedded").alias("hardcoded"), kept("config", "environment", "env").alias("config"),
        F.count_if(F.col("family").isin(*X.MIGRATION, *X.SAFE)).alias("replaceable"), F.count_if(known).alias("classified"))
    keys = F.col("kms") + F.col("hardcoded") + F.col("config")
    share = lambda a, b: F.try_divide(F.col(a), b)
    ranks = lambda x, *bounds: F.when(x >= 1, 100.0).when(x >= bounds[0], 75.0).when(x >= bounds[1], 50.0)
    wraps, ready, central = share("wrapped", F.col("calls")), share("replaceable", F.col("classified")), share("kms", keys)
    out = by.select("project_id", step(F.col("files"), [(3, 100.0), (10, 75.0), (25, 50.0), (50, 25.0)], 0.0).alias("concentration"), ranks(wraps, 0.70, 0.30).when(wraps > 0, 25.0).otherwise(0.0).alias("abstraction"),
                    step(F.col("algorithms"), [(2, 100.0), (5, 75.0), (10, 50.0), (20, 25.0)], 0.0).alias("diversity"),
                    F.when(keys == 0, 100.0).when(central >= 1, 100.0).when(central >= 0.5, 75.0).when(F.col("hardcoded") == 0, 50.0).when(share("hardcoded", keys) < 0.5, 25.0).otherwise(0.0).alias("key_management"),
                    F.when(F.col("classified") == 0, 100.0).otherwise(ranks(ready, 0.75, 0.5).when(ready >= 0.25, 25.0).otherwise(0.0)).alias("readiness"), F.col("hardcoded").alias("n_hardcoded"))
    score = F.bround(F.col("concentration") * 0.2 + F.col("abstraction") * 0.25 + F.col("diversity") * 0.15 + F.col("key_management") * 0.2 + F.col("readiness") * 0.2, 1)
    label = lambda s: F.when(s >= 80, "Highly Agile").when(s >= 60, "Moderately Agile").when(s >= 40, "Limited Agility").otherwise("Rigid")
    return out.withColumn("score", score).withColumn("label", label(F.col("score")))
