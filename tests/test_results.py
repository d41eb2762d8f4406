"""Foreign results and documents: both engine forms, a broken file among good ones, properties by asset type."""

import json

import pytest

from keyloom.sources import results


def frame(spark, docs):
    return spark.createDataFrame([(f"d{i}", d if d is None or isinstance(d, str) else json.dumps(d)) for i, d in enumerate(docs)], "source string, value string")


def test_pattern_results(spark):
    one = {"check_id": "rules.python.cbom-python-weak", "path": "a.py", "start": {"line": 3, "col": 5}, "end": {"line": 3, "col": 9}, "extra": {"message": "m", "severity": "ERROR", "lines": "x = 1", "metavars": {"$ALGO": {"abstract_content": "MD5"}}, "metadata": {"cbom-primitive-from-metavar": "$ALGO", "cbom-primitive-fallback": "HASH", "confidence": "HIGH", "category": "inventory", "default_enabled": False, "cbom-asset-type": "algorithm", "cbom-library": " lib "}}}
    two = {"check_id": "own", "path": "b.py", "start": {"line": "x"}, "extra": {"metadata": {"cbom-primitive": "AES", "noise_risk": "med"}}}
    docs = frame(spark, [{"results": [one, two], "errors": [{"message": "ignored"}]}, "{broken", {"results": [], "errors": [{"message": "no rules"}, {"message": "bad path"}]}, "  \n", None, {"results": []}, {"other": 1}, "[1, 2]"])
    got = sorted(results.pattern_results(docs).collect(), key=lambda r: r.seq)
    assert [(r.source, r.rule_id, r.name, r.file, r.line, r.col, r.severity, r.confidence, r.category, r.default_enabled, r.noise_risk, r.library) for r in got] == [
        ("d0", "cbom-python-weak", "weak", "a.py", 3, 5, "high", "high", "inventory", False, "low", "lib"), ("d0", "own", "own", "b.py", None, None, "info", "medium", "security", True, "medium", None)]
    assert (got[0].primitive, got[1].primitive) == ("MD5", "AES") and (got[0].snippet, got[0].end_col, got[0]["pass"]) == ("x = 1", 9, 2)
    assert {(r.source, r.reason) for r in results.refused(docs).collect()} == {("d1", "invalid JSON"), ("d2", "no results, 2 errors: no rules; bad path")}


def test_byte_results_are_named_by_their_meta(spark):
    meta = lambda **m: {"rule": m.pop("rule"), "file": m.pop("file", "lib.so"), "meta": m}
    matches = [
        {**meta(rule="md5_constants", cbom_asset_type="algorithm", cbom_primitive="MD5", description="MD5 table"), "strings": [{"identifier": "$a", "offset": 8222, "match": "x"}, {"identifier": "$b", "offset": 1}]},
        meta(rule="pem_private_key", cbom_asset_type="related-crypto-material", cbom_primitive="RSA"), meta(rule="private_any", cbom_asset_type="related-crypto-material", file=""), meta(rule="x509", cbom_asset_type="certificate"),
        meta(rule="openssl", cbom_asset_type="library", cbom_library="OpenSSL", cbom_primitive="OPENSSL-3.1"), {"rule": "bare"}]
    got = sorted(results.byte_results(frame(spark, [{"matches": matches}, {"matches": []}, "{"]), target="t.bin").collect(), key=lambda r: r.seq)
    assert [(r.name, r.severity, r.family, r.material, r.library_version, r.col, r.file) for r in got] == [
        ("MD5", "info", "md5", None, None, 8222, "lib.so"), ("RSA private key", "high", None, "private-key", None, 0, "lib.so"), ("Private key", "high", None, "private-key", None, 0, "t.bin"),
        ("X.509 certificate (embedded)", "info", None, None, None, 0, "lib.so"), ("OpenSSL", "info", None, None, "3.1", 0, "lib.so"), ("bare", "info", None, None, None, 0, "t.bin")]
    assert got[0].snippet == "[binary] md5_constants $a at offset 0x201e" and got[0].description == "MD5 table" and got[5].description == 'Rule "bare" matched'


@pytest.mark.parametrize("own", ["algorithm", "protocol", "certificate", "related-crypto-material"])
def test_policy_documents_show_their_own_properties(spark, own):
    properties = {
        "assetType": own, "algorithmProperties": {"primitive": "hash", "algorithmFamily": "md5", "mode": "cbc", "padding": "pkcs7", "classicalSecurityLevel": 128, "cryptoFunctions": ["digest", "sign"]}, "protocolProperties": {"type": "tls", "version": "1.2", "cipherSuites": [{"name": "a"}, {"name": "b"}]},
        "certificateProperties": {"subjectName": "s", "issuerName": "i", "notValidBefore": "b", "notValidAfter": "e", "certificateFormat": "X.509"}, "relatedCryptoMaterialProperties": {"type": "private-key", "state": "active", "size": 256}}
    doc = {"components": [{"name": "n", "cryptoProperties": properties, "evidence": {"occurrences": [{"location": "f", "line": 4}, {"location": "g"}]}}, {"bom-ref": "r", "name": "plain"}]}
    one, plain = sorted(results.read_cbom_policy(frame(spark, [doc, "{"])).collect(), key=lambda r: r.seq)
    shown = {"algorithm": (one.primitive, one.family, one.mode, one.padding, one.key_size, one.functions), "protocol": (one.protocol, one.protocol_version, one.cipher_suites), "certificate": (one.subject, one.issuer, one.not_before, one.not_after, one.certificate_format), "related-crypto-material": (one.material, one.state, one.material_size)}
    want = {"algorithm": ("hash", "md5", "cbc", "pkcs7", 128, ["digest", "sign"]), "protocol": ("tls", "1.2", ["a", "b"]), "certificate": ("s", "i", "b", "e", "X.509"), "related-crypto-material": ("private-key", "active", 256)}
    assert shown[own] == want[own] and all(set(v) == {None} for k, v in shown.items() if k != own)
    assert (one.finding_id, one.file, one.line) == ("CBOM-1", "f", 4) and (one.quantum_status, one.severity) == (("broken", "critical") if own == "algorithm" else ("unknown", "info"))
    assert (plain.finding_id, plain.asset_type, plain.quantum_status, plain.severity) == ("r", None, None, None)


def test_diff_names_every_property(spark):
    from keyloom.operators import drift

    schema = "ref string, crypto struct<mode:string,size:int,inner:struct<a:string>>, functions array<string>, properties map<string,string>, seq int"
    before = [("same", ("cbc", 1, ("x",)), ["b", "a"], {"p": "1"}, 1), ("twice", ("old", 1, None), [], {}, 1), ("twice", ("cbc", 1, None), [], {}, 2), ("gone", None, None, None, 1), (None, ("cbc", None, ("x",)), None, {"p": "1", "q": "2"}, 1)]
    after = [("same", ("cbc", 1, ("x",)), ["a", "b", "a"], {"p": "1"}, 9), ("twice", ("gcm", 2, None), ["s"], {"new": "n"}, 1), ("new", None, None, None, 1), (None, ("cbc", 3, ("y",)), ["a"], {"q": "2"}, 1)]
    got = drift.diff_properties(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema), ["ref"], ["crypto", "functions", "properties"], "seq").collect()
    assert {r.ref: (r.change, [tuple(c) for c in r.changes]) for r in got} == {
        "same": ("unchanged", []), "gone": ("removed", []), "new": ("added", []),
        "twice": ("changed", [("crypto.mode", "cbc", "gcm"), ("crypto.size", "1", "2"), ("functions", "", "s"), ("properties.new", None, "n")]),
        None: ("changed", [("crypto.inner.a", "x", "y"), ("crypto.size", None, "3"), ("functions", None, "a"), ("properties.p", "1", None)])}


def test_document_vocabulary_counts_misses_in_the_same_pass(spark):
    from keyloom.functions import vocabulary

    rows = [("AES", "gcm"), ("aes ", "weird"), ("none", None), (None, ""), ("ChaCha20-Poly1305", "XTS"), ("none", "weird")]
    out, seen = vocabulary.normalise_document(spark.createDataFrame(rows, "family string, mode string"), {"family": "family", "mode": "mode"})
    assert [tuple(r) for r in out.collect()] == [("AES", "gcm"), ("AES", "other"), ("", ""), ("", ""), ("ChaCha20", "other"), ("", "other")]
    assert seen.get == {"family_misses": 2, "mode_misses": 2}
    for field, (table, _) in vocabulary.FIELDS.items():
        spelled = [s for v in table.values() for s in v.split()]
        assert len(spelled) == len(set(spelled)), field


def test_contained_names_meet_few_texts(spark):
    """The same rows as comparing every component with every text, with a fraction of the pairs."""
    import random

    from pyspark.sql import functions as F

    from keyloom.operators import links

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 7)))
    parts = [(p, 1, 1, rng.choice([word(), word().upper(), None, ""] if rng.random() < 0.2 else [word()])) for p in (1, 2) for _ in range(60)] + [(1, 0, 0, "older"), (3, 1, 1, "alone")]
    findings = [(p, rng.choice([None, word() + "-" + word()]), rng.choice([None, f"src/{word()}{word()}.py"])) for p in (1, 2) for _ in range(200)]
    components = spark.createDataFrame(parts, "project_id int, sbom_id int, created_at int, name string")
    rows = spark.createDataFrame(findings, "project_id int, name string, file string")
    want = {}
    for p, sbom, _, name in parts:
        if sbom == 1:
            met = [f for f in findings if f[0] == p and name is not None and any(x is not None and name.lower() in x.lower() for x in f[1:])]
            n, names = want.get((p, name), (0, set()))
            want[p, name] = n + len(met), names | {f[1] for f in met if f[1] is not None}
    got = {(r.project_id, r.library): (r.findings_count, r.crypto_findings) for r in links.sbom_links(components, rows).collect()}
    assert got == {k: (n, ",".join(sorted(names))) for k, (n, names) in want.items()}
    long = components.where("length(name) >= 4 AND sbom_id = 1").select("project_id", F.col("name").alias("library"))
    pairs = links.candidates(long, rows, "project_id", F.lower("library"), ["name", "file"]).count()
    assert 0 < pairs < 0.05 * long.count() * 200


def test_candidates_carry_only_the_texts_that_hold_a_needle(spark):
    """While a key has few needles, its texts are not taken apart: a pair is a text with a needle it holds."""
    from pyspark.sql import functions as F

    from keyloom.operators import links

    parts = spark.createDataFrame([(1, "brand#13"), (1, "aes"), (2, "openssl")], "project_id int, library string")
    texts = spark.createDataFrame([(p, "AES-128", f"src/brand#{k}/x.py") for p in (1, 2) for k in range(30)], "project_id int, name string, file string")
    pairs = links.candidates(parts, texts, "project_id", F.lower("library"), ["name", "file"]).groupBy("project_id", "library").count().collect()
    assert {(r.project_id, r.library): r["count"] for r in pairs} == {(1, "brand#13"): 1, (1, "aes"): 30}


def test_a_document_is_parsed_once_to_be_refused(spark):
    docs = frame(spark, ["{", " \n\t", None, {"results": [], "errors": [{"message": "a"}, {}]}, {"results": [1]}])
    out = results.refused(docs)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    assert {(r.source, r.reason) for r in out.collect()} == {("d0", "invalid JSON"), ("d3", "no results, 2 errors: a; ")}
