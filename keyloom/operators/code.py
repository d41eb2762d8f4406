"""Source code as Spark expressions: a lexer by language, signatures and fingerprints, redaction, and constants that flow into calls.

The lexer is one alternation that is matched from left to right, so that a comment's sign inside a string is text and a quote inside
a comment is comment: each match is a string, a comment or code. Everything stays in the JVM and within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Languages by the sign that begins a line comment, and those with text between three quotes or back-quotes.
HASH = ("python", "ruby", "shell", "yaml")
SLASH = ("java", "go", "javascript", "typescript", "c", "cpp", "csharp", "rust", "kotlin", "swift", "dart")
BOTH = ("php",)
TRIPLE, BACKQUOTE = ("python", "kotlin", "swift", "java", "dart"), ("go", "javascript", "typescript")
# Words that a signature never takes for a variable.
KEYWORDS = (
    "if else for while do return break continue switch case default goto class def func function import from package interface struct enum type extends implements abstract final static public private protected internal "
    "true false nil null undefined new this self super try catch throw throws finally except raise void var let const val async await yield with as in is not and or").split()
TYPED = ("java", "kotlin", "dart", "csharp", "cpp")

_STRINGS = r'"(?:\\.|[^"\\\n])*"?|' + r"'(?:\\.|[^'\\\n])*'?"
_TRIPLES = r'"""[\s\S]*?(?:"""|\z)|' + r"'''[\s\S]*?(?:'''|\z)|"
_IDENT = "[A-Za-z0-9_]"


def _lexed(text: Column, hashes: bool, slashes: bool, triple: bool, back: bool) -> Column:
    """The text's tokens: strings, comments, and runs of anything else."""
    comments = ([r"/\*[\s\S]*?(?:\*/|\z)", r"//[^\n]*"] if slashes else []) + ([r"#[^\n]*"] if hashes else [])
    strings = (_TRIPLES if triple else "") + _STRINGS + (r"|`[^`]*`?" if back else "")
    # a quote is always a string's; a comment's first sign alone is code
    signs = r"\"'" + ("`" if back else "") + ("/" if slashes else "") + ("#" if hashes else "")
    return F.regexp_extract_all(text, F.lit("(" + "|".join([strings, *comments, f"[^{signs}]+", r"[\s\S]"]) + ")"), F.lit(1))


def _without_comments(text: Column, hashes: bool, slashes: bool, triple: bool = False, back: bool = False, keep_lines: bool = True) -> Column:
    starts = (["/*", "//"] if slashes else []) + (["#"] if hashes else [])

    def kept(token: Column) -> Column:
        comment = token.startswith(starts[0])
        for s in starts[1:]:
            comment |= token.startswith(s)
        return F.when(comment, F.regexp_replace(token, r"[^\n]+", "") if keep_lines else F.lit("")).otherwise(token)

    return F.array_join(F.transform(_lexed(text, hashes, slashes, triple, back), kept), "")


def strip_comments(text: Column, language: Column, keep_lines: bool = True) -> Column:
    """The text without its language's comments; line ends inside of block comments stay if ``keep_lines``. A language that is not
    known is read as one with both signs; text that holds none of them is passed through."""
    out = F.when(F.lit(False), text)
    for known, hashes, slashes in ((HASH, True, False), (SLASH, False, True)):
        for triple, back in ((True, False), (False, True), (False, False)):
            own = [x for x in known if (x in TRIPLE) == triple and (x in BACKQUOTE) == back]
            if own:
                out = out.when(language.isin(*own), _without_comments(text, hashes, slashes, triple, back, keep_lines))
    plain = ~(F.contains(text, F.lit("#")) | F.contains(text, F.lit("//")) | F.contains(text, F.lit("/*")))
    return F.when(plain, text).otherwise(out.otherwise(_without_comments(text, True, True, keep_lines=keep_lines)))


def signature(snippet: Column, language: Column) -> Column:
    """A snippet without what changes cosmetically: comments by language, spacing, literals (``_STR_``, ``_NUM_``) and names of
    variables (``_VAR_``): bare lower-case names that are no keyword, no member, no prefix of a member and no call. Declarations of the language are
    levelled first: short ones of Go, ``var``/``let``/``const`` of JavaScript, typed ones of the Java family."""
    bare = strip_comments(snippet, language, keep_lines=False)
    text = F.trim(F.regexp_replace(bare, r"\s+", " "))
    text = F.regexp_replace(text, r'"(?:\\.|[^"\\])*"', "_STR_")
    text = F.regexp_replace(text, r"'(?:\\.|[^'\\])*'", "_STR_")
    text = F.regexp_replace(text, "`[^`]*`", "_STR_")
    for number in (r"0[xX][0-9a-fA-F]+", r"[0-9]+\.[0-9]+", r"[0-9]+"):
        text = F.regexp_replace(text, rf"(?<!{_IDENT}){number}(?!{_IDENT})", "_NUM_")
    names = rf"(?<!{_IDENT})[a-zA-Z_]{_IDENT}*(?:\s*,\s*[a-zA-Z_]{_IDENT}*)*\s*:="
    short = F.transform(F.regexp_extract_all(text, F.lit(f"({names}|[\\s\\S])"), F.lit(1)), _short_declaration)
    text = F.when(language == "go", F.array_join(short, "")).when(language == "javascript", F.regexp_replace(text, rf"(?<!{_IDENT})(?:var|let|const)\s+", "")).when(
        language.isin(*TYPED), F.regexp_replace(text, rf"(?<!{_IDENT})[A-Z]{_IDENT}*(?:<[^>]*>)?\s+[a-z_]{_IDENT}*\s*=", "_VAR_ =")).otherwise(text)
    kept = "|".join((*KEYWORDS, "_STR_", "_NUM_", "_VAR_"))
    text = F.regexp_replace(text, rf"(?<![A-Za-z0-9_.])(?!(?:{kept})(?!{_IDENT}))[a-z_]{_IDENT}*+(?![.(])", "_VAR_")
    text = F.regexp_replace(text, r"\s+", " ")
    for a, b in (("( ", "("), (" )", ")"), (" ,", ",")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(text)


def _short_declaration(token: Column) -> Column:
    names = F.size(F.split(token, ","))
    return F.when(F.endswith(token, F.lit(":=")), F.concat(F.array_join(F.array_repeat(F.lit("_VAR_"), names), ", "), F.lit(" :="))).otherwise(token)


def code_fingerprint(rule: Column, path: Column, snippet: Column, language: Column) -> Column:
    return F.sha2(F.concat_ws(":", rule, path, signature(snippet, language)).cast("binary"), 256)


#: Names that look like a user's own: with underscores or mixed case.
_OWN_NAME = r"(?<![A-Za-z0-9_])(?:[a-z][a-zA-Z]*(?:_[a-zA-Z]+)+|[a-z]+[A-Z][a-zA-Z]*)(?![A-Za-z0-9_])"


def redact(code: Column, language: Column, comments: bool = True, names: bool = False) -> Column:
    """Code for others' eyes: without comments, and with own names replaced by ``VAR_n`` in the order in which they are first seen."""
    out = strip_comments(code, language) if comments else code
    if not names:
        return out

    def renamed(parts: Column) -> Column:
        own = F.array_distinct(F.filter(parts, lambda p: p.rlike(f"^{_OWN_NAME}$")))
        return F.array_join(F.transform(F.arrays_zip(parts.alias("p")), lambda x: F.when(F.array_contains(own, x["p"]), F.concat(F.lit("VAR_"), F.array_position(own, x["p"]).cast("string"))).otherwise(x["p"])), "")

    parts = F.regexp_extract_all(out, F.lit(f"({_OWN_NAME}|{_IDENT}+|[^A-Za-z0-9_]+)"), F.lit(1))
    return F.transform(F.array(parts), renamed)[0]


def assignments(lines: DataFrame) -> DataFrame:
    """(path, line, name, value) of literals that a line assigns to a variable."""
    pattern = r"(?:^|[\s;{])(?:(?:const|final|let|var|val|static|private|public|string|String|auto|char\s*\*?|byte\[\])\s+)*\$?([A-Za-z_][A-Za-z0-9_]*)\s*(?::\s*[A-Za-z]+\s*)?:?=\s*[bru]?[\"']([^\"'\n]*)[\"']"
    rows = lines.where(F.col("text").rlike(pattern))
    return rows.select("path", "line", F.regexp_extract("text", pattern, 1).alias("name"), F.regexp_extract("text", pattern, 2).alias("value"))


def as_of(assigned: DataFrame, uses: DataFrame) -> DataFrame:
    """Every row of ``uses`` (path, name, line, ...) with the ``value`` last assigned to the name on an earlier line of its file, or null.

    Both sides are put in one sorted run for each (file, name), where the last value is carried on: linear in the rows, whereas a join would
    pair every use with every assignment. Of several values on a line the greatest counts."""
    more = [c for c in uses.columns if c not in ("path", "name", "line")]
    facts = assigned.groupBy("path", "name", "line").agg(F.max("value").alias("value"))
    facts = facts.select("path", "name", "line", F.lit(1).alias("kind"), F.struct("value").alias("v"), *(F.lit(None).cast(uses.schema[c].dataType).alias(c) for c in more))
    asked = uses.select("path", "name", "line", F.lit(0).alias("kind"), F.lit(None).cast("struct<value:string>").alias("v"), *more)
    before = W.partitionBy("path", "name").orderBy("line", "kind").rowsBetween(W.unboundedPreceding, 0)
    rows = asked.unionByName(facts).withColumn("value", F.last("v", ignorenulls=True).over(before)["value"])
    return rows.where("kind = 0").select("path", "name", "line", *more, "value")
