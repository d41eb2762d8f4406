"""Operators on small hand-made rows."""

import hashlib
import json

from pyspark.sql import functions as F

from keyloom.functions import crypto as X
from keyloom.operators import detect, drift, frameworks, links, policy, portfolio
from keyloom.sources import documents
from keyloom.streaming import streams


def lines(spark, text, path="a.py"):
    return detect.explode_lines(spark.createDataFrame([(path, text)], "path string, content string"))


def test_family_order_matters(spark):
    df = spark.createDataFrame([("3DES",), ("ECDSA-P256",), ("SHA-512",), ("Kyber",), (None,), ("x",)], "name string")
    got = [r.f for r in df.select(X.algorithm_family(F.col("name")).alias("f")).collect()]
    assert got == ["3des", "ecdsa", "sha512", "ml-kem", "unknown", "unknown"]


def test_nist_takes_the_first_findings_size(spark):
    rows = [(1, "RSA", None, 1, 1, 1, 1), (1, "RSA", 4096, 2, 1, 1, 1), (2, "RSA", 4096, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "project_id int, name string, key_size int, scan_id int, seq int, part int, supp int")
    got = {r.project_id: r.classification for r in portfolio.compliance_nist(df).collect()}
    assert got == {1: "disallowed", 2: "deprecated"}


def test_empty_portfolio_has_a_row(spark):
    df = spark.createDataFrame([], "name string, severity string")
    assert portfolio.pqc_overview(df).first().total == 0


def test_diff_of_equal_inventories_is_unchanged(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "k string, v int")
    assert {r.change for r in drift.diff(df, df, ["k"], ["v"]).collect()} == {"unchanged"}


def test_match_is_sticky_and_reopens(spark):
    old = spark.createDataFrame([(1, "a", "resolved", 0), (1, "b", "open", 0), (1, "c", "false_positive", 2)], "project_id int, fingerprint string, status string, reopen_count int")
    new = spark.createDataFrame([(1, "a"), (1, "d"), (1, None)], "project_id int, fingerprint string")
    got = {r.fingerprint: (r.action, r.next_status, r.reopen_count) for r in drift.match_findings(old, new).collect()}
    assert got == {"a": ("reopened", "open", 1), "b": ("resolved", "resolved", 0), "c": ("kept", "false_positive", 2), "d": ("new", "open", 0), None: ("new", "open", 0)}


def test_dedupe_keeps_first_pass_duplicates(spark):
    schema = "finding_id string, file string, line int, name string, confidence string, severity string, description string"
    one = spark.createDataFrame([("1", "F", 1, "A", "low", "low", "x"), ("2", "f", 1, "a", "low", "low", "x")], schema)
    two = spark.createDataFrame([("3", "f", 1, "A", "high", "high", "y"), ("4", "g", 1, "A", "low", "low", "z")], schema)
    got = {r.finding_id: (r.confidence, r.description) for r in drift.dedupe_passes(one, two).collect()}
    assert got == {"1": ("low", "x"), "2": ("high", "x [Pass 2: y]"), "4": ("low", "z")}


def test_pem_state_marks_lines_between(spark):
    got = detect.mark_pem_blocks(lines(spark, "-----BEGIN KEY-----\nabc\n-----END KEY-----\nx")).orderBy("line")
    assert [r.inside for r in got.collect()] == [False, True, True, False]


def test_detectors(spark):
    src = lines(spark, 'x = hashlib.md5("MD5")\nMD5é and xMD5\n-----BEGIN RSA PRIVATE KEY-----\ncommit ' + "a" * 40 + "\n" + "b" * 32)
    assert sorted((r.line, r.token) for r in detect.scan_algorithm_names(src).collect()) == [(1, "MD5"), (2, "MD5"), (3, "RSA")]
    assert [r.material for r in detect.scan_pem_headers(src).collect()] == ["RSA PRIVATE KEY"]
    assert detect.scan_hex_keys(src).collect() == []  # a block without an end goes on
    assert [r.bits for r in detect.scan_hex_keys(lines(spark, "b" * 32)).collect()] == [128]


def test_fingerprints_leave_comments_of_all_lines_out(spark):
    texts = ["a = 1 # one\nb = 22", "a = 7\nb = 3 // two", "/* x\ny */a = 0\nb = 5#", "a = 1é\nb = 2", "a = 1x\nb = 2"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", detect.fingerprint(F.lit("r"), F.lit("p"), F.col("text")).alias("f"))
    want = ["a = NUM b = NUM"] * 3 + ["a = NUMé b = NUM", "a = 1x b = NUM"]
    assert [r.f for r in df.orderBy("i").collect()] == [hashlib.sha256(f"r:p:{x}".encode()).hexdigest() for x in want]


def test_names_of_the_reference(spark):
    names = ["MD5", "SHA-1", "SHA1", "DES", "3DES", "TripleDES", "RC4", "Blowfish", "SSLv3", "TLSv1.0", "TLSv1.1", "SHA-256", "AES-128", "AES256", "RSA", "RSA-2048"]
    got = detect.scan_algorithm_names(lines(spark, "\n".join(names) + "\nTLSv1x0 RSAx")).orderBy("line").collect()
    assert [(r.line, r.token) for r in got] == [(i + 1, x.removesuffix("-2048")) for i, x in enumerate(names)]
    assert [r.name for r in got[:3]] == ["MD5", "SHA-1", "SHA-1"] and got[-1].quantum_status == "quantum-vulnerable" and got[-1].category == "inventory"


def test_keys_leave_pem_blocks_ids_and_digests_out(spark):
    a, b, c, k = "a" * 32, "b" * 40, "c" * 33, "Zz+/" * 12
    src = lines(spark, "\n".join(["-----BEGIN KEY-----", a + " " + k, "-----END KEY-----", a, f"id-{a} {a}-x", f"-{c}- {b}", f"Revision {b} {a}", f"sha: {b}", f"{k}==", f"SHA512-{k} sha256-{k}", f"commit {k}"]))
    assert sorted((r.line, r.token) for r in detect.scan_hex_keys(src).collect()) == [(4, a), (6, b), (6, c), (7, a)]
    found = sorted((r.line, r.token) for r in detect.scan_base64_keys(src).collect())
    assert found == [(6, b), (7, b), (8, b), (9, k + "==")]


def test_calls_leave_comments_out(spark):
    files = spark.createDataFrame([("a.py", '# hashlib.md5("x")\nh = hashlib.md5("y")')], "path string, content string")
    assert [(r.line, r.family, r.argument) for r in detect.scan_calls(spark, files).collect()] == [(2, "md5", "y")]


def test_config_scanners(spark):
    got = detect.scan_tls_config(lines(spark, "ssl_protocols TLSv1 TLSv1.3;\nssl_ciphers AES:RC4-SHA:!MD5;", "nginx.conf"))
    assert sorted((r.token, r.severity) for r in got.collect()) == [("RC4-SHA", "high"), ("TLSv1", "high"), ("TLSv1.3", "info")]
    joined = detect.logical_lines(lines(spark, "a=1,\\\n2\nb"))
    assert [r.text for r in joined.orderBy("line").collect()] == ["a=1,2", "b"]


def test_constants_and_kdf(spark):
    got = detect.propagate_constants(lines(spark, 'a = "MD5"\na = "AES"'))
    assert [(r.name, r.value) for r in got.collect()] == [("a", "AES")]
    calls = spark.createDataFrame([("pbkdf2", "1000"), ("pbkdf2", "x"), ("bcrypt", "12"), ("bcrypt", "4")], "kdf string, rounds string")
    assert sorted(r.rounds for r in detect.check_kdf(calls).collect()) == ["1000", "4"]


def test_cascade_lock_wins(spark):
    base = spark.createDataFrame([(1,), (2,)], "k int")
    org = spark.createDataFrame([(1, "warn", True), (2, "warn", False)], "k int, action string, locked boolean")
    grp = spark.createDataFrame([(1, "ignore", False), (2, "ignore", False)], "k int, action string, locked boolean")
    assert {r.k: (r.source, r.action) for r in policy.cascade(base, [("org", org), ("group", grp)], "k").collect()} == {1: ("org", "warn"), 2: ("group", "ignore")}


def test_documents_round_trip(spark, tmp_path):
    doc = {"bomFormat": "CycloneDX", "serialNumber": "s", "components": [{"type": "x", "bom-ref": "r", "name": "RSA", "cryptoProperties": {"assetType": "algorithm", "algorithmProperties": {"primitive": "PKE"}}, "evidence": {"occurrences": [{"location": "f", "line": 3}]}, "properties": [{"name": "severity", "value": "high"}]}, {"name": "y"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc))
    got = documents.read_cbom(spark, str(tmp_path / "a.json")).orderBy("seq").collect()
    assert [(r.name, r.severity, r.rule_id, r.family, r.line) for r in got] == [("RSA", "high", "upload-RSA", "pke", 3), ("y", "medium", "upload-y", None, None)]
    (tmp_path / "b.json").write_text(json.dumps({"spdxVersion": "2.3", "packages": [{"name": "z", "versionInfo": "1", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:z"}]}, {"name": ""}]}))
    assert [(r.name, r.purl) for r in documents.read_sbom(spark, str(tmp_path / "b.json")).collect()] == [("z", "pkg:z")]


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "svc", "1.2", "2024-01-01 10:00:00"), (2, 1, "svc", "1.0", "2024-01-01 11:00:00"), (3, 1, "svc", "1.3", "2024-01-05 10:00:00")], "event_id long, project_id long, service_name string, tls_version string, observed_at string").withColumn("observed_at", F.to_timestamp("observed_at"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    streams.run_available(streams.ingest(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    streams.run_available(streams.daily(stream), str(tmp_path / "days"), str(tmp_path / "cp2"))
    closed = {(r.day, r.n) for r in spark.read.parquet(str(tmp_path / "days")).collect()}
    assert closed <= {(r.day, r.n) for r in portfolio.daily_counts(rows).collect()} and ("2024-01-01", 2) in closed


def test_frameworks_judge_sizes(spark):
    rows = [(1, 1, 1, 1, 1, "AES", 128), (1, 1, 2, 1, 1, "RSA", 1024), (1, 1, 3, 1, 1, "RSA", 4096), (1, 1, 4, 1, 1, None, None), (1, 2, 1, 1, 1, "MD5", None)]
    df = spark.createDataFrame(rows, "project_id long, scan_id long, seq int, part long, supp long, name string, key_size int")
    got = {k: {r.family: r.classification for r in frameworks.items(df, k).collect()} for k in frameworks.FRAMEWORKS}
    assert got["fips-140-3"] == {"aes": "approved", "rsa": "not-approved", "unknown": "not-approved", "md5": "not-approved"}
    assert got["pci-dss-v4"] == {"aes": "compliant", "rsa": "non-compliant", "unknown": "unknown", "md5": "non-compliant"}
    assert got["cnsa-2"] == {"aes": "not-approved", "rsa": "deprecated", "unknown": "not-approved", "md5": "disallowed"}
    iso = {r.check_id: (r.status, r.findings_count, r.evidence) for r in frameworks.iso_checklist(df).collect()}
    assert iso["A.8.24-3"] == ("fail", 1, "md5") and iso["A.8.24-4"] == ("fail", 3, "rsa: 1024 < 2048") and iso["A.8.24-6"] == ("pass", 0, "") and len(iso) == 10
    assert {(r.framework, r.score) for r in frameworks.scores(df).collect()} == {("fips-140-3", 20.0), ("pci-dss-v4", 20.0), ("cnsa-2", 0.0)}


def test_sbom_links_take_the_latest_document(spark):
    parts = spark.createDataFrame([(1, 1, 5, "old"), (1, 2, 6, "RSA"), (1, 2, 6, "none"), (2, 3, 1, "x")], "project_id long, sbom_id long, created_at long, name string")
    found = spark.createDataFrame([(1, "rsa-2048", "a.py"), (1, "rsa-2048", "a.py"), (1, None, "RSA.py"), (1, "md5", None), (3, "x", "x")], "project_id long, name string, file string")
    got = {(r.project_id, r.library): (r.findings_count, r.crypto_findings) for r in links.sbom_links(parts, found).collect()}
    assert got == {(1, "RSA"): (3, "rsa-2048"), (1, "none"): (0, ""), (2, "x"): (0, "")}


def test_messages_and_progress_of_streams(spark, tmp_path):
    spark.createDataFrame([(1, "critical_finding", "t", [1, 2]), (2, "other", "u", [1])], "event_id long, trigger string, title string, user_ids array<long>").write.parquet(str(tmp_path / "in"))
    prefs = spark.createDataFrame([(2, "critical_finding", False)], "user_id long, trigger string, in_app boolean")
    stream = spark.readStream.schema("event_id long, trigger string, title string, user_ids array<long>").parquet(str(tmp_path / "in"))
    streams.run_available(streams.alerts(stream, prefs), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted((r.event_id, r.user_id, r.subject) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1, "[CRITICAL] t"), (2, 1, "[INFO] u")]
    seen = spark.createDataFrame([(1, 10, 1), (1, 60, 3), (1, 30, 2)], "scan_id long, percent int, s long").select("scan_id", "percent", F.timestamp_seconds("s").alias("ts"))
    assert [(r.scan_id, r.percent) for r in streams.progress(seen).collect()] == [(1, 60)]


def test_lifecycle_keeps_history_and_repeats_a_batch(spark, tmp_path):
    """Two uploads: what is gone is resolved, what comes back reopens; history holds the changes of each batch."""
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    stream = spark.readStream.schema("project_id long, fingerprint string").parquet(str(source))

    def upload(*names):
        spark.createDataFrame([(1, n) for n in names], "project_id long, fingerprint string").coalesce(1).write.mode("append").parquet(str(source))
        streams.lifecycle(stream, out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    for names in (("a", "b"), ("b",), ("a", "b")):
        upload(*names)
    state = lambda n: {r.fingerprint: (r.status, r.reopen_count) for r in spark.read.parquet(f"{out}/findings/batch={n}").collect()}
    assert (state(0), state(1), state(2)) == ({"a": ("open", 0), "b": ("open", 0)}, {"a": ("resolved", 0), "b": ("open", 0)}, {"a": ("open", 1), "b": ("open", 0)})
    changes = [sorted(tuple(r)[1:] for r in spark.read.parquet(f"{out}/history/batch={n}").collect()) for n in range(3)]
    assert changes == [[("a", None, "open"), ("b", None, "open")], [("a", "open", "resolved")], [("a", "resolved", "open")]]


def test_cra_gaps_name_families_and_sizes(spark):
    rows = [(1, 1, 1, 1, 1, "AES", 64), (1, 1, 2, 1, 1, "MD5", None), (1, 1, 3, 1, 1, "RSA", None), (1, 1, 4, 1, 1, "RSA", 512), (2, 1, 1, 1, 1, None, None)]
    df = spark.createDataFrame(rows, "project_id long, scan_id long, seq int, part long, supp long, name string, key_size int")
    got = {(r.project_id, r.requirement_id): tuple(r)[2:] for r in frameworks.cra_gaps(df).collect()}
    assert len(got) == 20
    assert got[1, "CRA-ANNEX-I-3a"] == ("gap", "aes", 1, "Replace aes with approved encryption (AES-128+, ChaCha20)")
    assert got[1, "CRA-ANNEX-I-3b"][:3] == ("gap", "md5", 1) and got[1, "CRA-ANNEX-I-5"][:3] == ("no-gap", "", 0)
    assert {v[0] for k, v in got.items() if k[0] == 2} == {"no-gap", "manual-review"}


def test_library_banners(spark):
    rows = [("a", b"\xff\x00OpenSSL 1.1.1k x OpenSSL 3.0.2"), ("b", b"BoringSSL and NSS 3.90"), ("c", b"OpenSSL is mentioned"), ("d", None), ("e", b"")]
    got = {tuple(r) for r in detect.library_banners(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got == {("a", "OpenSSL", "1.1.1k", "pkg:generic/openssl@1.1.1k", "cbom-binary-lib-openssl"), ("b", "BoringSSL", "", "", "cbom-binary-lib-boringssl"), ("b", "NSS", "3.90", "pkg:generic/nss@3.90", "cbom-binary-lib-nss")}


def test_dockerfiles(spark):
    text = "FROM x\n\trun apt-get install -y openssl\n# RUN apk add openssl\nRUN apk add openssl-3.0 libssl1.1\nRUN echo openssl\nEXPOSE 80 443/tcp 8443\nEXPOSE"
    rows = [("a/Dockerfile", text), ("b/main.go", text), ("c/Dockerfile.dev", None), ("d/x.dockerfile", "")]
    got = sorted((r.path, r.line, r.rule_id.rsplit("dockerfile-")[1], r.name[-4:]) for r in detect.dockerfile_findings(spark.createDataFrame(rows, "path string, content string")).collect())
    assert got == [("a/Dockerfile", 2, "unpinned-openssl", "tall"), ("a/Dockerfile", 4, "unpinned-crypto-lib", "tall"), ("a/Dockerfile", 6, "tls-port", " 443"), ("a/Dockerfile", 6, "tls-port", "8443")]


def test_java_security(spark):
    text = "# keystore.type=jks\njdk.tls.disabledAlgorithms=SSLv3, 3DES, \\ \n  RC4, TLSv1.1\n keystore.type = PKCS12 \nssl.TrustManagerFactory.algorithm=none\nssl.KeyManagerFactory.algorithm=pkix\njdk.certpath.disabledAlgorithms=MD5,RC4,DES,SSLv3\\"
    rows = [("a/java.security", text), ("b/java.txt", text), ("c/x.security", None), ("d/y.security", "")]
    got = sorted((r.path, r.line, r.name, r.severity) for r in detect.java_security_findings(spark.createDataFrame(rows, "path string, content string")).collect())
    missing = "Missing disabled algorithm: "
    assert got == [("a/java.security", 2, missing + "MD5", "high"), ("a/java.security", 3, "PKCS12", "info"), ("a/java.security", 5, "PKIX", "info"), ("a/java.security", 6, missing + "3DES", "medium")]


def test_rule_delta_sends_changes_once(spark, tmp_path):
    schema, sent = "org_id int, rule_id int, updated_at int", []
    add = lambda rows: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        rules = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        writer = streams.rule_delta(rules, 1, 10, lambda batch, i: sent.extend(r.rule_id for r in batch.collect()))
        writer.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()

    add([(1, 1, 10), (1, 2, 13), (1, 3, 12), (2, 4, 15), (1, 5, None)])
    run()
    add([(1, 1, 14)])
    run()
    assert sent == [3, 2, 1]


def test_boring_values(spark):
    from keyloom.operators.detect import is_boring

    boring = ["true", "0", "ChangeMe", "your_here", "your-api_key-here", "${X}", "{{x}}", "%x%", "<a b>", "[R]", '""', "'secret'", "abc", "***"]
    real = ["abcd", "ifChangemeQ7", "${X}y", "your_key", "\"it's\""]
    df = spark.createDataFrame([(v, v in boring) for v in boring + real], "v string, b boolean")
    assert df.where(is_boring(F.col("v")) != F.col("b")).collect() == []


def test_corpus_filters(spark):
    rows = [("src/a.py", b"x"), ("node_modules/a.py", b"x"), ("src/build", b"x"), ("build/x.o", b"x"), ("a/app.min.js", b"x"), ("docs/deep/n.txt", b"x"), ("gen/k/a.py", b"x"), ("r.json", b'{"bomFormat": "CycloneDX"}'), ("c.json", b'{"a": "sarif"}'), ("o.sarif", b"x")]
    files = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, size long, content binary")
    paths = lambda df: sorted(r.path for r in df.collect())
    assert paths(detect.drop_ignored(files, ("docs/**", "gen/"))) == ["c.json", "o.sarif", "r.json", "src/a.py", "src/build"]
    assert "build/x.o" in paths(detect.drop_ignored(files, binaries=True)) and "node_modules/a.py" not in paths(detect.drop_ignored(files, binaries=True))
    assert {"r.json", "o.sarif"}.isdisjoint(paths(detect.drop_own_outputs(files))) and "c.json" in paths(detect.drop_own_outputs(files))
    kept, skipped = detect.bound_corpus(files, max_size=10, only_paths=files.where("path LIKE '%.json' OR path = 'src/a.py'").select("path"))
    assert paths(kept) == ["src/a.py"] and skipped.first().skipped == 2
    cut = "é".encode() * 300
    texts = [("a.txt", b"ok"), ("b.txt", b"a\0b"), ("c.txt", b"\xff\xfe"), ("d.md", b"ok"), ("e.txt", b"x" + cut), ("f.txt", b"y" * 600 + b"\xff"), ("g.txt", b"")]
    assert paths(detect.text_only(spark.createDataFrame(texts, "path string, content binary"))) == ["a.txt", "e.txt", "f.txt", "g.txt"]


def test_paging_and_requests(spark):
    from keyloom.operators import portal

    rows = spark.range(60).withColumnRenamed("id", "k")
    assert [(r.k, r.total) for r in portal.paginate(rows, ["k"], 3).collect()] == [(k, 60) for k in range(50, 60)]
    assert portal.paginate(rows, ["k"], 9).count() == 0
    requests = spark.createDataFrame([(1, "pending", 7, "false_positive", 10), (2, "pending", 8, "false_positive", 11), (3, "approved", 7, "risk_accepted", 12)], "request_id long, request_status string, requested_by long, request_type string, finding_id long")
    decisions = spark.createDataFrame([(1, "approve", 7, "org_admin"), (2, "approve", 7, "org_admin"), (3, "reject", 7, "org_admin"), (4, "reject", 7, "org_admin")], "request_id long, decision string, actor long, role string")
    outcome, history = portal.apply_request_decisions(requests, decisions, spark.createDataFrame([(11, "open")], "finding_id long, status string"))
    assert {r.request_id: (r.error, r.status) for r in outcome.collect()} == {1: ("own request", "pending"), 2: (None, "approved"), 3: ("already approved", "approved"), 4: ("unknown request", None)}
    assert [tuple(r) for r in history.collect()] == [(11, "open", "false_positive", "Approved false_positive request")]


def test_policies_know_modes_and_versions(spark):
    f = spark.createDataFrame([(1, 1, "AES", "low", None, "ECB", None), (2, 1, "TLS", "low", None, None, "tlsv1.0"), (3, 1, "TLS", "low", None, None, "TLSv1.0"), (4, 1, "RSA", "low", 0, None, None)], "finding_id int, project_id int, name string, severity string, key_size int, mode string, protocol_version string")
    rules = policy.rules(spark, (("m", "low", "fail", None, None, None, None, None, ["ecb"], None), ("v", "low", "fail", None, None, None, None, None, None, ["TLSv1.0"]), ("s", "low", "fail", None, None, 2048, "RSA", None)))
    assert sorted((r.finding_id, r.rule) for r in policy.violations(f, rules).collect()) == [(1, "m"), (3, "v")]


def test_means_do_not_depend_on_the_order_of_addition(spark):
    """Scores whose mean lies on a tie, in many orders: tenths are summed as integers."""
    from keyloom.functions.crypto import mean_score

    scores = [38.9] * 17 + [39.0] * 17
    for seed in range(6):
        df = spark.createDataFrame([(s,) for s in scores], "score double").orderBy(F.rand(seed)).repartition(5)
        assert df.agg(F.bround(mean_score(F.col("score")), 1).alias("m")).first().m == 39.0
    assert spark.createDataFrame([], "score double").agg(mean_score(F.col("score")).alias("m")).first().m is None


def test_report_bundle_of_scans_with_and_without_findings(spark):
    from keyloom.operators import rollups

    scans = spark.createDataFrame([(1, 7, "completed", "t"), (2, 7, "completed", "t"), (3, 7, "queued", "t")], "scan_id long, project_id long, scan_status string, completed_at string")
    rows = [(1, "RSA-2048", "high", 2048, 1), (1, "RSA-4096", "low", None, 2), (1, "AES-128", "odd", 64, 3), (3, "MD5", "high", None, 4)]
    findings = spark.createDataFrame([(s, 7, n, v, k, i, 0, 0) for s, n, v, k, i in rows], "scan_id long, project_id long, name string, severity string, key_size int, seq int, part long, supp long")
    one, two = sorted(rollups.report_bundle(findings, scans).collect(), key=lambda r: r.scan_id)
    assert (two.findings, two.quantum_risk, two.nist_score, two.fips_score, two.families) == (0, 0.0, 100.0, 100.0, None)
    assert (one.findings, one.n_high, one.vulnerable, one.safe, one.broken) == (3, 1, 2, 1, 0)
    assert [(f.family, f.n, f.key_size, f.posture, f.nist, f.fips) for f in one.families] == [("aes", 1, 64, "safe", "disallowed", "not-approved"), ("rsa", 2, 2048, "vulnerable", "deprecated", "approved")]
    assert one.quantum_risk == round((7 + 1) * 100 / 60, 1) and one.nist_score == round(100 - (3 + 2) * 100 / 9, 1) and one.fips_score == 66.7


def test_accessible_projects_are_distinct_by_their_grants(spark):
    from keyloom.operators import portal

    groups = spark.createDataFrame([(1, 10, None), (2, 10, 1), (3, 20, None)], "group_id long, org_id long, parent_group_id long")
    projects = spark.createDataFrame([(p, g) for p, g in ((100, 1), (101, 2), (102, 3), (102, 2), (102, 3))], "project_id long, group_id long")
    scopes = [(1, "org", 10), (1, "group", 1), (1, "project", 101), (1, "project", 102), (2, "group", 2), (2, "group", 2), (3, "project", 100), (3, "project", 100), (4, "none", 1), (5, "project", 9)]
    users = spark.createDataFrame(scopes, "user_id long, scope string, scope_id long")
    out = portal.accessible_projects(users, projects, groups, portal.descendants(groups))
    assert sorted(map(tuple, out.collect())) == [(1, 100), (1, 101), (1, 102), (2, 101), (2, 102), (3, 100)]
    assert not out._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate"), "the pairs are compared with each other"


def test_accessible_projects_take_little_room_in_files(spark, tmp_path):
    """The pairs are users times projects, so that room must not grow with them as with other rows: 3.03 million, written in under half a byte each
    where neither side is small enough to broadcast."""
    from keyloom.operators import portal

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    groups = spark.createDataFrame([(1, 10, None), (2, 10, 1)], "group_id long, org_id long, parent_group_id long")
    projects = spark.range(101).select((F.col("id") * 7).alias("project_id"), F.lit(1).cast("long").alias("group_id"))
    users = spark.range(30_000).select((F.col("id") * 3).alias("user_id"), F.lit("org").alias("scope"), F.lit(10).cast("long").alias("scope_id"))
    try:
        portal.accessible_projects(users, projects, groups, portal.descendants(groups)).write.parquet(str(tmp_path / "pairs"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    back = spark.read.parquet(str(tmp_path / "pairs"))
    row = back.agg(F.count("*"), F.countDistinct("user_id"), F.countDistinct("project_id"), F.bit_xor(F.xxhash64("user_id", "project_id"))).first()
    whole = users.crossJoin(projects).agg(F.bit_xor(F.xxhash64("user_id", "project_id"))).first()
    assert tuple(row) == (3_030_000, 30_000, 101, whole[0])
    assert sum(x.stat().st_size for x in (tmp_path / "pairs").glob("*.parquet")) < 1_500_000


def test_accessible_projects_are_made_in_parts_of_bounded_pairs(spark, monkeypatch):
    from keyloom.operators import portal

    groups = spark.createDataFrame([(1, 10, None)], "group_id long, org_id long, parent_group_id long")
    projects = spark.range(200).select(F.col("id").alias("project_id"), F.lit(1).cast("long").alias("group_id"))
    users = spark.range(100).select(F.col("id").alias("user_id"), F.lit("org").alias("scope"), F.lit(10).cast("long").alias("scope_id"))
    monkeypatch.setattr(portal, "PAIRS", 500)
    monkeypatch.setattr(portal, "BLOCK", 4)
    out = portal.accessible_projects(users, projects, groups, portal.descendants(groups))
    by = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(by) == out.distinct().count() == 20_000 and max(by) <= 4_000 and len(by) > 16


def test_a_family_is_computed_once_in_a_filter(spark):
    """Posture, family and name stand in one another; written out in every branch of the filter they were computed some hundred times a row."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.range(4).select(F.element_at(F.array(F.lit("RSA-2048"), F.lit("3DES")), (F.col("id") % 2 + 1).cast("int")).alias("name"))
    out = portfolio.with_posture(rows).where("posture IN ('broken', 'vulnerable')")
    assert plan(out.select("posture")).count("element_at") <= 4
    assert sorted(r.posture for r in out.collect()) == ["broken", "broken", "vulnerable", "vulnerable"]
