"""Pattern rules over source code: a loader of rule files, a compiler of patterns, and a scan by an inverted index of literals.

A rule file (YAML, or JSON) has ``rules``: each with ``id``, ``message``, ``severity``, ``languages``, ``metadata`` and one of ``pattern``,
``pattern-either`` (any of them) and ``patterns`` (all of them at one line; a ``pattern-inside`` must begin before). A pattern is code with
``$NAME`` for any expression, the same wherever the name stands again, ``...`` for anything, ``"..."`` for any literal and ``"=~/x/"`` for a literal
that matches an expression. A pattern of several statements with ``...`` between them is met in their order in a file.

Each statement is compiled to a regular expression and to one word that must stand in a line for it to match. The scan takes the lines'
words apart, joins them to the statements by (language, word), and runs a statement's expression on the lines that it meets only. Statements
in order are put together per (file, pattern, bindings) by the line at which the first of them have been met, one row each, which is linear
in the matches.

A file that cannot be read, or has no rule, is refused; a rule without a pattern that can be compiled is listed with the reason.
"""

from __future__ import annotations

import json
import os
import re
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.operators import code
from keyloom.operators.detect import LANGUAGES, explode_lines, language

#: Statements of a table at most: it is broadcast.
MAX_STEPS = 50_000


class Step(NamedTuple):
    """A statement: its expression, the word that it needs, and the names that its groups bind."""

    regex: str
    word: str
    names: tuple[str, ...]


class Rule(NamedTuple):
    """``tree``: a list of steps, or ("any" | "all", trees); an ``inside`` is ("inside", steps)."""

    id: str
    languages: tuple[str, ...]
    severity: str
    message: str
    metadata: dict
    tree: object


_TOKEN = re.compile(r"""\s+|(?P<regex>["']=~/(?P<body>.*?)/["'])|(?P<any>[bBrRuUfF]?["']\.\.\.["'])|(?P<string>[bBrRuUfF]?(?:"[^"]*"|'[^']*'))|(?P<dots>\.\.\.)|(?P<var>\$[A-Z_][A-Z0-9_]*)|(?P<word>[A-Za-z0-9_]+)|(?P<sign>::|->|:=|[^\w\s])""")
_VALUE = r"""([A-Za-z_$@][A-Za-z0-9_$]*(?:(?:\.|::|->)[A-Za-z_][A-Za-z0-9_]*)*|[bBrRuUfF]?"[^"\n]*"|[bBrRuUfF]?'[^'\n]*'|[0-9][0-9A-Za-z_.]*|\*)"""
_COMMON = frozenset("new import from use const let var val return public private static final void require func function class package using include true false null nil self this string int".split())


def compile_step(text: str) -> Step:
    """The expression of one statement. What a ``...`` at the end stands for need not be on the line."""
    text = text.strip().rstrip(";").rstrip()
    text = re.sub(r"(?:,?\s*\.\.\.\s*[)\]}\s;]*)+$", "", text) if re.search(r"\.\.\.\s*[)\]};\s]*$", text) and not re.search(r"""\.\.\.["']\s*[)\]};\s]*$""", text) else text
    found = [m for m in _TOKEN.finditer(text) if m.group().strip()]
    if sum(len(m.group()) for m in _TOKEN.finditer(text)) != len(text):
        raise ValueError("has signs that are not understood")
    out, names, words, before = [], [], [], ""
    for m in found:
        kind, own = m.lastgroup if m.lastgroup != "body" else "regex", m.group()
        kind = "regex" if m["regex"] else kind
        wordlike = kind in ("word", "var")
        gap = r"\s+" if before == "word" and wordlike else r"\s*"
        if out:
            out.append(gap)
        if kind == "regex":
            out.append(rf"""["'][^"'\n]*?(?:{m['body']})[^"'\n]*["']""")
        elif kind == "any":
            out.append(r"""[bBrRuUfF]?["'][^"'\n]*["']""")
        elif kind == "string":
            body = own[own.index(own[-1]) + 1 : -1]
            if re.fullmatch(r"\$[A-Z_][A-Z0-9_]*", body):
                if body in names:
                    out.append(rf"""["']\{names.index(body) + 1}["']""")
                else:
                    names.append(body)
                    out.append(r"""[bBrRuUfF]?["']([^"'\n]*)["']""")
            else:
                out.append(rf"""[bBrRuUfF]?["']{re.escape(body)}["']""")
                words += re.findall(r"[A-Za-z0-9_]+", body)
        elif kind == "dots":
            out.append(r"[^\n]*?")
        elif kind == "var":
            if own in names:
                out.append(rf"\{names.index(own) + 1}")
            else:
                names.append(own)
                out.append(_VALUE)
        elif kind == "word":
            out.append(own)
            words.append(own)
        else:
            out.append(re.escape(own))
        before = "word" if wordlike else kind
    if not words and "=" not in text:
        raise ValueError("has no word that a line must hold")
    first, last = found[0].lastgroup, found[-1].lastgroup
    left = r"(?<![A-Za-z0-9_$.])" if first in ("word", "var") else ""
    right = r"(?![A-Za-z0-9_])" if last == "word" else ""
    rare = [w for w in words if w not in _COMMON] or words or ["="]
    return Step(left + "".join(out) + right, max(rare, key=len), tuple(names))


def compile_pattern(text: str) -> list[Step]:
    """A pattern's statements in order. Lines of brackets alone bind nothing and are left out."""
    steps = []
    for line in text.strip().split("\n"):
        if re.sub(r"\.\.\.|[\s{}()\[\];,]", "", line):
            steps.append(compile_step(line))
    if not steps:
        raise ValueError("is empty")
    return steps


def _tree(node: dict):
    for key, value in node.items():
        if key == "pattern":
            return compile_pattern(value)
        if key == "pattern-inside":
            return "inside", compile_pattern(value)
        if key in ("pattern-either", "patterns"):
            if not isinstance(value, list) or not value:
                raise ValueError(f"{key} is no list")
            return "any" if key == "pattern-either" else "all", [_tree(v) for v in value]
        if key.startswith("pattern"):
            raise ValueError(f"{key} is not supported")
    raise ValueError(f"{next(iter(node), 'a rule without a pattern')} is not supported")


def compile_rules(source: dict) -> tuple[list[Rule], list[tuple[str, str]]]:
    """The rules of one file's content, and (id, reason) of those that can't be compiled."""
    found = source.get("rules") if isinstance(source, dict) else None
    if not isinstance(found, list) or not found:
        raise ValueError("no rules found")
    rules, refused, seen = [], [], set()
    for r in found:
        if not isinstance(r, dict) or not r.get("id") or not r.get("languages"):
            raise ValueError("a rule needs an id and languages")
        if r["id"] in seen:
            raise ValueError(f"{r['id']} is there twice")
        seen.add(r["id"])
        try:
            rules.append(Rule(r["id"], tuple(r["languages"]), str(r.get("severity", "INFO")), " ".join(str(r.get("message", "")).split()), r.get("metadata") or {}, _tree({k: v for k, v in r.items() if k.startswith("pattern")})))
        except ValueError as why:
            refused.append((r["id"], str(why)))
    return rules, refused


def load_rules(folder: str, built_in: dict[str, list[Rule]] | None = None) -> tuple[dict[str, list[Rule]], list[tuple[str, str]]]:
    """Rules by language of a folder's ``<language>.yml`` and ``.json`` files; a language without a file keeps the built-in ones.
    A file that can't be read and a folder without a rule file are errors."""
    out, refused, found = dict(built_in or {}), [], 0
    for name in sorted(os.listdir(folder)):
        stem, ext = os.path.splitext(name)
        if ext not in (".yml", ".yaml", ".json"):
            continue
        found += 1
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            text = f.read()
        try:
            rules, bad = compile_rules(_parsed(text, ext))
        except ValueError as why:
            raise ValueError(f"{name}: {why}") from why
        out[stem] = rules
        refused += bad
    if not found:
        raise ValueError("no rule files found")
    return out, refused


def _parsed(text: str, ext: str) -> dict:
    if ext == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as gone:
        raise ValueError("YAML can't be read here; give the rules as JSON") from gone
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as why:
        raise ValueError(str(why)) from why


def _leaves(tree, found: list[list[Step]]) -> object:
    """The tree with the numbers of its patterns in place of them."""
    if isinstance(tree, list):
        found.append(tree)
        return len(found) - 1
    return (tree[0], _leaves(tree[1], found)) if tree[0] == "inside" else (tree[0], [_leaves(t, found) for t in tree[1]])


def _met(tree, leaves: Column) -> Column:
    """Whether a line at which the patterns ``leaves`` end meets a tree."""
    if isinstance(tree, int):
        return F.array_contains(leaves, tree)
    parts = [_met(t, leaves) for t in (tree[1] if isinstance(tree[1], list) else [tree[1]])]
    out = parts[0]
    for p in parts[1:]:
        out = out | p if tree[0] == "any" else out & p
    return out


def _inside(tree) -> set[int]:
    if isinstance(tree, int):
        return set()
    return {tree[1]} if tree[0] == "inside" else set().union(*map(_inside, tree[1]))


def scan_rules(files: DataFrame, rules: list[Rule]) -> DataFrame:
    """(path, line, rule_id, severity, primitive, message) of each rule at each line where a match of it ends, once. ``primitive``
    comes from the metadata: stated, or bound by a name with a fallback."""
    spark = files.sparkSession
    table, trees, within = [], [], []
    for n, rule in enumerate(rules):
        found: list[list[Step]] = []
        trees.append(_leaves(rule.tree, found))
        within += [(n, leaf) for leaf in _inside(trees[-1])]
        source = rule.metadata.get("cbom-primitive-from-metavar") or rule.metadata.get("cbom-primitive-curve-from-metavar")
        for leaf, steps in enumerate(found):
            shared = [v for v in dict.fromkeys(v for s in steps for v in s.names) if sum(v in s.names for s in steps) > 1]
            for k, s in enumerate(steps):
                groups = [s.names.index(v) + 1 if v in s.names else 0 for v in shared]
                for lang in rule.languages:
                    table.append((lang, s.word, n, leaf, k, len(steps), s.regex, groups, s.names.index(source) + 1 if source in s.names else 0))
    if len(table) > MAX_STEPS:
        raise ValueError(f"rules have {MAX_STEPS} statements at most")
    steps = spark.createDataFrame(table, "lang string, word string, rule int, leaf int, step int, steps int, regex string, groups array<int>, source int")

    lang = language(F.col("path"))
    own = files.select("path", "content", lang.alias("lang")).where(F.col("lang").isin(sorted({t[0] for t in table})))
    lines = explode_lines(own.select("path", code.strip_comments(F.col("content"), F.col("lang")).alias("content"))).where("text <> ''").withColumn("lang", language(F.col("path")))
    asked = ", ".join(f"'{w}'" for w in sorted({t[1] for t in table})) or "''"  # each row of a word carries its line, so only words that a statement needs make one
    needed = F.expr(f"array_distinct(filter(regexp_extract_all(text, '([A-Za-z0-9_]+|=)', 1), w -> w IN ({asked})))")
    words = lines.select("path", "line", "lang", "text", F.explode(needed).alias("word"))
    met = words.join(F.broadcast(steps), ["lang", "word"]).where(F.expr("text rlike regex"))
    unquoted = "trim(BOTH '\"\'\'' FROM regexp_extract(text, regex, {}))"
    bound = F.expr(f"transform(groups, g -> {unquoted.format('g')})")
    met = met.select("path", "line", "rule", "leaf", "step", "steps", bound.alias("bound"), F.expr(f"CASE WHEN source > 0 THEN {unquoted.format('source')} END").alias("value"))
    hits = met.where("steps = 1").select("path", "line", "rule", "leaf", "value")

    # the line at which the first k statements have been met, in order and with the same bindings; then the matches of the next after it
    key = ["path", "rule", "leaf", "bound"]
    longest = max((t[5] for t in table), default=1)
    if longest > 1:
        ordered = met.where("steps > 1")
        reached = ordered.where("step = 0").groupBy(*key).agg(F.min("line").alias("since"), F.max("value").alias("known"))
        for k in range(1, longest):
            after = ordered.where(F.col("step") == k).join(reached, key).where(F.col("line") > F.col("since")).withColumn("value", F.coalesce("value", "known"))
            hits = hits.unionByName(after.where(F.col("steps") == k + 1).select("path", "line", "rule", "leaf", "value"))
            reached = after.groupBy(*key).agg(F.min("line").alias("since"), F.max("value").alias("known"))

    by = hits.groupBy("path", "line", "rule").agg(F.collect_set("leaf").alias("leaves"), F.max("value").alias("value"))
    if within:
        inner = reduce(or_, ((F.col("rule") == n) & (F.col("leaf") == leaf) for n, leaf in within))
        begun = hits.where(inner).groupBy("path", "rule", "leaf").agg(F.min("line").alias("since")).groupBy("path", "rule").agg(F.collect_list(F.struct("leaf", "since")).alias("around"))
        around = F.transform(F.filter("around", lambda a: a["since"] <= F.col("line")), lambda a: a["leaf"])
        by = by.join(begun, ["path", "rule"], "left").withColumn("leaves", F.array_union("leaves", F.coalesce(around, F.array().cast("array<int>"))))
    whole = F.lit(True)
    for n, tree in enumerate(trees):
        if not (isinstance(tree, int) or tree[0] == "any" and all(isinstance(t, int) for t in tree[1])):
            whole = F.when(F.col("rule") == n, _met(tree, F.col("leaves"))).otherwise(whole)
    known = spark.createDataFrame([(n, r.id, r.severity, r.message, r.metadata.get("cbom-primitive") or r.metadata.get("cbom-primitive-fallback")) for n, r in enumerate(rules)], "rule int, rule_id string, severity string, message string, stated string")
    out = by.where(whole).join(F.broadcast(known), "rule")
    return out.select("path", "line", "rule_id", "severity", F.coalesce(F.nullif("value", F.lit("")), "stated").alias("primitive"), "message")


def dry_run(spark: SparkSession, rule: dict, text: str, path: str = "test") -> DataFrame:
    """(line, code, message) where a rule, as its file has it, matches test code of its first language; an unusable rule is an error."""
    rules, refused = compile_rules({"rules": [rule]})
    if refused:
        raise ValueError(refused[0][1])
    ext = next((e for e, lang in LANGUAGES.items() if lang == rules[0].languages[0]), ".txt")
    file = spark.createDataFrame([(f"{path}{ext}", text)], "path string, content string")
    found = scan_rules(file, rules).select("line", "message")
    return explode_lines(file).select("line", F.col("text").alias("code")).join(found, "line").orderBy("line")
