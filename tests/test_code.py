"""Lexer, signatures, redaction, constants and pattern rules on hand-made code, and rules against brute force."""

import json
import re

import pytest
from pyspark.sql import functions as F

from keyloom.operators import binary, code, configs, detect, rules
from keyloom.plans import code as plans

SF = "/root/testdata/sf0.001"


def one(spark, language, text, f):
    return spark.createDataFrame([(language, text)], "language string, text string").select(f(F.col("text"), F.col("language")).alias("x")).first().x


@pytest.mark.parametrize(("language", "text", "bare"), [
    ("python", 'url = "http://a#b"; hashlib.sha1(z) # no', 'url = "http://a#b"; hashlib.sha1(z) '), ("java", "int a = 1 # 2; // no", "int a = 1 # 2; "), ("go", "x := `// yes` // no", "x := `// yes` "),
    ("c", "a /* one\ntwo */ b", "a \n b"), ("java", r'"a\"// yes" // no', r'"a\"// yes" '), ("python", '"""# yes\n# yes"""\n# no', '"""# yes\n# yes"""\n'), ("php", "a # no\nb // no\nc", "a \nb \nc"),
    ("java", "'\"' // no", "'\"' "), ("java", "/* open", ""), ("other", "a // no\nb # no", "a \nb "), ("python", "a // 2", "a // 2"), ("java", None, None), ("java", "", ""), ("javascript", "it's // no", "it's // no")])
def test_comments_by_language(spark, language, text, bare):
    assert one(spark, language, text, code.strip_comments) == bare


@pytest.mark.parametrize(("language", "text", "signature"), [
    ("python", "algo = 'md5'  # x\nh = hashlib.new(algo)", "_VAR_ = _STR_ _VAR_ = hashlib.new(_VAR_)"), ("go", "key, err := aes.New(k, 0x1F)", "_VAR_, _VAR_ := aes.New(_VAR_, _NUM_)"),
    ("java", 'Map<String,X> m = foo.get( "k" , 3.14 );', "_VAR_ = foo.get(_STR_, _NUM_);"), ("javascript", "const a = `x${b}`; return a", "_VAR_ = _STR_; return _VAR_"), ("c", "if (x1 == 10) return NULL;", "if (_VAR_ == _NUM_) return NULL;"), ("ruby", "Digest::MD5.hexdigest(x)", "Digest::MD5.hexdigest(_VAR_)")])
def test_signatures_by_language(spark, language, text, signature):
    assert one(spark, language, text, code.signature) == signature


def test_redaction_renames_in_order_of_first_sight(spark):
    text = "companyKey = load_secret(path) # private\nother = companyKey; MyClass.load_secret"
    assert one(spark, "python", text, lambda t, l: code.redact(t, l, names=True)) == "VAR_1 = VAR_2(path) \nother = VAR_1; MyClass.VAR_2"
    assert one(spark, "python", text, code.redact) == text.replace("# private", "")


def test_values_as_of_a_line(spark):
    assigned = spark.createDataFrame([("f", "a", 1, "x"), ("f", "a", 5, "y"), ("f", "a", 5, "z"), ("g", "a", 1, "w")], "path string, name string, line int, value string")
    uses = spark.createDataFrame([("f", "a", 1, "u"), ("f", "a", 2, "u"), ("f", "a", 5, "u"), ("f", "a", 9, "u"), ("f", "b", 9, "u"), ("f", "a", 9, "u")], "path string, name string, line int, more string")
    got = code.as_of(assigned, uses)
    assert sorted((r.name, r.line, r.value) for r in got.collect()) == [("a", 1, None), ("a", 2, "x"), ("a", 5, "x"), ("a", 9, "z"), ("a", 9, "z"), ("b", 9, None)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_calls_take_arguments_from_constants(spark):
    files = spark.createDataFrame([("a.py", 'algo = "md5"; hashlib.new(algo)\nalgo = "sha512"\nhashlib.new(algo, x)\nhashlib.new(other)\n# hashlib.md5(x)\nurl = "http://a#b"; hashlib.sha1(z)')], "path string, content string")
    got = sorted((r.line, r.token, r.argument, r.resolved_family) for r in detect.scan_calls(spark, files).collect())
    assert got == [(1, "hashlib.new", "md5", "md5"), (3, "hashlib.new", "sha512", "sha512"), (4, "hashlib.new", "", "unknown"), (6, "hashlib.sha1", "", "sha1")]
    with pytest.raises(ValueError):
        detect.scan_calls(spark, files, [("python", "a", "", "", "")] * (detect.MAX_CALLS + 1))


def by_hand(path, content, ruleset, lexed):
    """Rules on every line of one file in plain Python, without an index."""
    lines, out = lexed.split("\n"), set()

    def ends(steps):
        """Lines at which the statements end in order, with the same bindings."""
        states = {(-1, ())}
        for k, s in enumerate(steps):
            new = set()
            for n, line in enumerate(lines):
                if m := re.search(s.regex, line):
                    own = {v: m.group(i + 1).strip("\"'") for i, v in enumerate(s.names)}
                    for at, bound in states:
                        known = dict(bound)
                        if at < n and all(known.get(v, x) == x for v, x in own.items()):
                            new.add((n, tuple(sorted({**known, **own}.items()))))
            states = new
        return {n for n, _ in states}

    def lines_of(tree):
        if isinstance(tree, list):
            return ends(tree)
        if tree[0] == "inside":
            found = ends(tree[1])
            return set(range(min(found), len(lines))) if found else set()
        parts = [lines_of(t) for t in tree[1]]
        return set.union(*parts) if tree[0] == "any" else set.intersection(*parts)

    lang = detect.LANGUAGES.get("." + path.rsplit(".", 1)[-1], "other")
    for r in ruleset:
        if lang in r.languages:
            out |= {(path, n + 1, r.id) for n in lines_of(r.tree)}
    return out


def test_rules_equal_brute_force(spark):
    """Every rule on every line of all documents, against the scan by words."""
    ruleset, refused = rules.compile_rules(plans.PACK)
    files = plans.corpus(spark, SF).withColumn("lexed", code.strip_comments(F.col("content"), detect.language(F.col("path"))))
    want = set().union(*(by_hand(r.path, r.content, ruleset, r.lexed) for r in files.collect()))
    got = {(r.path, r.line, r.rule_id) for r in rules.scan_rules(files.select("path", "content"), ruleset).collect()}
    assert got == want and not refused and {x[2] for x in got} == {r.id for r in ruleset}


def test_rule_files_are_loaded_or_refused(tmp_path, spark):
    python = {"rules": [{"id": "a", "languages": ["python"], "pattern": "f($X)"}, {"id": "b", "languages": ["python"], "pattern": "$X"}, {"id": "c", "languages": ["python"], "patterns": [{"pattern": "g(...)"}, {"metavariable-regex": {}}]}]}
    (tmp_path / "python.json").write_text(json.dumps(python))
    (tmp_path / "notes.txt").write_text("no rules")
    built_in = {"python": [], "java": rules.compile_rules({"rules": [{"id": "j", "languages": ["java"], "pattern": "h()"}]})[0]}
    loaded, refused = rules.load_rules(str(tmp_path), built_in)
    assert [r.id for r in loaded["python"]] == ["a"] and [r.id for r in loaded["java"]] == ["j"]
    assert refused == [("b", "has no word that a line must hold"), ("c", "metavariable-regex is not supported")]
    for bad in ("{", "[]", '{"rules": []}', '{"rules": [{"id": "x"}]}', '{"rules": [{"id": "x", "languages": ["c"], "pattern": "f()"}, {"id": "x", "languages": ["c"], "pattern": "g()"}]}'):
        (tmp_path / "go.json").write_text(bad)
        with pytest.raises(ValueError, match="go.json"):
            rules.load_rules(str(tmp_path))
    (tmp_path / "empty").mkdir()
    with pytest.raises(ValueError, match="no rule files"):
        rules.load_rules(str(tmp_path / "empty"))


def test_a_rule_is_tried_on_code(spark):
    rule = {"id": "t", "languages": ["go"], "message": "Weak", "pattern": "md5.New()"}
    assert [tuple(r) for r in rules.dry_run(spark, rule, "package x\n// md5.New()\nh := md5.New()").collect()] == [(3, "h := md5.New()", "Weak")]
    assert rules.dry_run(spark, rule, "").count() == 0
    with pytest.raises(ValueError):
        rules.dry_run(spark, {"id": "t", "languages": ["go"], "pattern": "$X"}, "x")


def test_tables_of_the_standards():
    by = {c.name: c for c in binary.known_constants()}
    assert by["AES S-box"].data[:16].hex() == "637c777bf26b6fc53001672bfed7ab76" and by["AES inverse S-box"].data[:8].hex() == "52096ad53036a538"
    assert by["SHA-256 round constants"].data[:8].hex() == "428a2f9871374491" and by["SHA-512 round constants"].data[:8].hex() == "428a2f98d728ae22"
    assert by["MD5 table"].data[:4].hex() == "78a46ad7" and by["Blowfish P-array"].data.hex().startswith("243f6a8885a308d3") and by["Blowfish P-array"].data.hex().endswith("9216d5d98979fb1b")
    assert by["SHA-256 initial state, little-endian"].data[:4].hex() == "67e6096a" and list(by["DES initial permutation"].data[:9]) == [58, 50, 42, 34, 26, 18, 10, 2, 60]
    assert by["DES initial permutation"].data[32:34] == bytes([57, 49]) and by["RSA identifier"].data.hex() == "2a864886f70d0101" and by["Ed25519 identifier"].data.hex() == "2b6570"


def test_byte_constants_equal_brute_force(spark):
    import random

    rng = random.Random(6)
    table = [binary.ByteConstant(f"c{i}", f"f{i % 4}", f"p{i % 2}", bytes(rng.choices(b"ab\x00\xff", k=rng.randint(1, 6))), rng.randint(0, 7)) for i in range(14)]
    table.append(binary.ByteConstant("none", "f9", "p", b""))
    files = [(i, None if i == 3 else bytes(rng.choices(b"ab\x00\xffc", k=rng.randint(0, 60)))) for i in range(80)] + [(5, b"ab" * 100_000)]

    def by_hand(data):
        out, seen = [], set()
        for c in table:
            if c.needle and (c.family, c.primitive) not in seen and (at := data.find(c.needle)) >= 0:
                seen.add((c.family, c.primitive))
                out.append((c.name, c.family, c.primitive, "info", at))
        return out

    df = spark.createDataFrame(files, "path int, content binary").repartition(3)
    want = sorted((i, *r) for i, data in files for r in by_hand(data or b""))
    assert sorted(map(tuple, binary.scan_byte_constants(df, tuple(table)).collect())) == want
    assert binary.scan_byte_constants(df, ()).count() == 0 and binary.scan_byte_constants(df.where("false")).count() == 0
    plan = binary.scan_byte_constants(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan


def test_server_configs_need_their_marks(spark):
    files = [("notes.txt", "ssl_protocols are SSLv3 or so"), ("a.conf", "protocols SSLv3"), ("b.conf", "nginx\n  ssl_protocols  tlsv1.0 ;\nssl_ciphers '!RC4:MD5';"), ("c.conf", "<VirtualHost *>\n SSLProtocol +tlsv1.1 -SSLv3\n#SSLCipherSuite RC4\nSSLCipherSuite RC4:EXP"), ("d.conf", None), ("e.conf", "")]
    got = sorted((r.path, r.line, r.rule_id.removeprefix("cbom-configfile-"), r.detail) for r in configs.scan_server_config(spark.createDataFrame(files, "path string, content string")).collect())
    assert got == [("b.conf", 2, "nginx-weak-protocol", "tlsv1.0"), ("b.conf", 3, "nginx-weak-cipher", "MD5"), ("c.conf", 2, "httpd-weak-protocol", "TLSv1.1"), ("c.conf", 4, "httpd-weak-cipher", "EXP"), ("c.conf", 4, "httpd-weak-cipher", "RC4")]
