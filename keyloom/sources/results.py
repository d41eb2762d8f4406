"""Results of other engines and inventory documents for policies, read from JSON text as VARIANT values.

Frames have ``source`` and ``value`` (one JSON document a row). A document that is no JSON, and one of a pattern engine that has errors and no
result, is refused: it gives no finding and a row of :func:`refused`. A blank document has no finding and is not refused. Fields that are
missing or of another type are null, and take the mapping's defaults.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.crypto import algorithm_family, clean_rule_id, once
from keyloom.functions.normalise import infer_posture, map_engine_fields, resolve_primitive

# What a rule's name begins with.
_RULE_PREFIX = "^cbom-(?:(?:javascript|python|kotlin|swift|java|ruby|rust|dart|csharp|cpp|php|js|go)-)?"
_MAPPED = ("severity", "confidence", "asset_type", "category", "maturity", "noise_risk", "default_enabled")


def _parsed(documents: DataFrame) -> DataFrame:
    """The document as a VARIANT (null: not JSON), and whether it is blank."""
    return documents.select("source", "value", F.try_parse_json("value").alias("doc"), (~F.rlike(F.coalesce("value", F.lit("")), F.lit(r"\S"))).alias("blank"))


def _text(v: Column | str, path: str) -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, "string")


def _int(v: Column | str, path: str) -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, "int")


def _items(v: str, path: str) -> Column:
    return F.coalesce(F.try_variant_get(F.col(v), path, "array<variant>"), F.array().cast("array<variant>"))


def refused(documents: DataFrame) -> DataFrame:
    """(source, reason) of the documents that can't be used. A document is parsed once: the reason is exploded, since a filter on it would move
    down and parse at every mention of the document."""
    items = lambda doc, path: F.coalesce(F.try_variant_get(doc, path, "array<variant>"), F.array().cast("array<variant>"))

    def reason(doc: Column) -> Column:
        errors = lambda e: F.concat(F.lit("no results, "), F.size(e).cast("string"), F.lit(" errors: "), F.array_join(F.transform(e, lambda x: F.coalesce(F.try_variant_get(x, "$.message", "string"), F.lit(""))), "; "))
        failed = F.when(F.size(items(doc, "$.results")) == 0, once(items(doc, "$.errors"), lambda e: F.when(F.size(e) > 0, errors(e))))
        return F.when(doc.isNull() | (F.schema_of_variant(doc) == "VOID"), F.lit("invalid JSON")).otherwise(failed)

    rows = documents.where(F.rlike(F.coalesce("value", F.lit("")), F.lit(r"\S")))
    return rows.select("source", F.explode(F.array_compact(F.array(once(F.try_parse_json("value"), reason)))).alias("reason"))


def pattern_results(documents: DataFrame) -> DataFrame:
    """Findings (pass 2) of a pattern engine: rule, place, name, mapped metadata, and the canonical primitive: the rule's own, else what
    the named metavariable caught, else the fallback."""
    rows = _parsed(documents).select("source", F.posexplode(_items("doc", "$.results")).alias("seq", "r"))
    meta = lambda key: _text("r", f'$.extra.metadata["{key}"]')
    bound = F.try_variant_get("r", "$.extra.metavars", "map<string,variant>")
    caught = F.try_variant_get(F.element_at(bound, meta("cbom-primitive-from-metavar")), "$.abstract_content", "string")
    rule = clean_rule_id(_text("r", "$.check_id"))
    out = rows.select(
        "source", "seq", F.lit(2).alias("pass"), rule.alias("rule_id"), F.regexp_replace(rule, _RULE_PREFIX, "").alias("name"), _text("r", "$.extra.message").alias("description"), _text("r", "$.path").alias("file"),
        _int("r", "$.start.line").alias("line"), _int("r", "$.start.col").alias("col"), _int("r", "$.end.line").alias("end_line"), _int("r", "$.end.col").alias("end_col"), _text("r", "$.extra.lines").alias("snippet"),
        _text("r", "$.extra.severity").alias("severity"), meta("confidence").alias("confidence"), meta("cbom-asset-type").alias("asset_type"), meta("category").alias("category"), meta("maturity").alias("maturity"), meta("noise_risk").alias("noise_risk"),
        F.try_variant_get("r", "$.extra.metadata.default_enabled", "boolean").alias("default_enabled"), resolve_primitive(meta("cbom-primitive"), caught, meta("cbom-primitive-fallback")).alias("primitive"), F.trim(meta("cbom-library")).alias("library"))
    return map_engine_fields(out)


def byte_results(documents: DataFrame, target: str = "") -> DataFrame:
    """Findings (pass 3) of a byte-rule engine, named by their rules' metadata (:func:`apply_rule_meta`). ``col`` is the offset of the first string, 0
    without one; a match without a file is in ``target``."""
    rows = _parsed(documents).select("source", F.posexplode(_items("doc", "$.matches")).alias("seq", "m"))
    meta = lambda key: _text("m", f'$.meta["{key}"]')
    first = F.get(_items("m", "$.strings"), F.lit(0))
    rule, offset = _text("m", "$.rule"), F.coalesce(F.try_variant_get(first, "$.offset", "int"), F.lit(0))
    place = F.when(first.isNull(), F.concat(F.lit("[binary] match: "), rule)).otherwise(F.concat(F.lit("[binary] "), rule, F.lit(" "), F.try_variant_get(first, "$.identifier", "string"), F.lit(" at offset 0x"), F.lower(F.hex(offset))))
    out = rows.select(
        "source", "seq", F.lit(3).alias("pass"), rule.alias("rule_id"), F.coalesce(F.nullif(meta("description"), F.lit("")), F.concat(F.lit('Rule "'), rule, F.lit('" matched'))).alias("description"),
        F.coalesce(F.nullif(_text("m", "$.file"), F.lit("")), F.lit(target)).alias("file"), F.lit(0).alias("line"), offset.alias("col"), place.alias("snippet"),
        F.lit("INFO").alias("severity"), F.lit("medium").alias("confidence"), meta("cbom_asset_type").alias("asset_type"), meta("category").alias("category"), meta("maturity").alias("maturity"), meta("noise_risk").alias("noise_risk"),
        F.try_variant_get("m", '$.meta["default_enabled"]', "boolean").alias("default_enabled"), F.trim(meta("cbom_primitive")).alias("token"), F.trim(meta("cbom_library")).alias("library"))
    return apply_rule_meta(map_engine_fields(out))


def apply_rule_meta(rows: DataFrame) -> DataFrame:
    """Name, severity, family, material and library version of byte-rule findings (rule_id, asset_type, token, library): an algorithm is its token, a
    private key is a leak of high severity, a library takes its version from the token's tail."""
    token, has = F.coalesce("token", F.lit("")), F.coalesce("token", F.lit("")) != ""
    algorithm, material = F.col("asset_type") == "algorithm", F.col("asset_type") == "related-crypto-material"
    private = material & F.contains(F.lower("rule_id"), F.lit("private"))
    known = F.coalesce("library", F.lit("")) != ""
    library = ~F.col("asset_type").isin("algorithm", "certificate", "related-crypto-material", "protocol") & known
    name = (F.when(algorithm & has, token).when(F.col("asset_type") == "certificate", "X.509 certificate (embedded)").when(private & has, F.concat(token, F.lit(" private key"))).when(private, "Private key")
            .when(library, F.col("library")).otherwise(F.col("rule_id")))
    version = F.when(library & F.startswith(F.lower(token), F.concat(F.lower("library"), F.lit("-"))), F.substr(token, F.length("library") + 2))
    return rows.withColumns({
        "name": name, "severity": F.when(private, "high").otherwise(F.col("severity")), "family": F.when(algorithm & has, algorithm_family(token)), "material": F.when(private, "private-key"),
        "library_version": F.nullif(version, F.lit("")), "primitive": resolve_primitive(token, F.lit(None).cast("string"), F.lit(None).cast("string"))}).drop("token")


def read_cbom_policy(documents: DataFrame) -> DataFrame:
    """Components of inventory documents as policies see them: properties of the component's own asset type only, the classical security level as
    key size, posture inferred from the family and severity from the posture; a component without a reference is ``CBOM-n``."""
    rows = _parsed(documents).select("source", F.posexplode(_items("doc", "$.components")).alias("seq", "c"))
    kind = _text("c", "$.cryptoProperties.assetType")
    of = lambda asset, value: F.when(kind == asset, value)
    alg, protocol, cert, material = (f"$.cryptoProperties.{x}Properties" for x in ("algorithm", "protocol", "certificate", "relatedCryptoMaterial"))
    level = F.coalesce(_int("c", f"{alg}.classicalSecurityLevel"), F.lit(0))
    first = F.get(_items("c", "$.evidence.occurrences"), F.lit(0))
    names = lambda path, key: F.transform(_items("c", path), lambda x: F.try_variant_get(x, key, "string"))
    family = of("algorithm", _text("c", f"{alg}.algorithmFamily"))
    has = F.try_variant_get("c", "$.cryptoProperties", "variant").isNotNull()
    posture = F.when(has, infer_posture(F.coalesce(family, F.lit(""))))
    return rows.select(
        "source", "seq", F.coalesce(F.nullif(_text("c", '$["bom-ref"]'), F.lit("")), F.concat(F.lit("CBOM-"), (F.col("seq") + 1).cast("string"))).alias("finding_id"), _text("c", "$.name").alias("name"), _text("c", "$.description").alias("description"),
        F.try_variant_get(first, "$.location", "string").alias("file"), F.try_variant_get(first, "$.line", "int").alias("line"), kind.alias("asset_type"),
        of("algorithm", _text("c", f"{alg}.primitive")).alias("primitive"), family.alias("family"), of("algorithm", _text("c", f"{alg}.mode")).alias("mode"), of("algorithm", _text("c", f"{alg}.padding")).alias("padding"), of("algorithm", F.when(level > 0, level)).alias("key_size"), of("algorithm", names(f"{alg}.cryptoFunctions", "$")).alias("functions"),
        of("protocol", _text("c", f"{protocol}.type")).alias("protocol"), of("protocol", _text("c", f"{protocol}.version")).alias("protocol_version"), of("protocol", names(f"{protocol}.cipherSuites", "$.name")).alias("cipher_suites"),
        of("certificate", _text("c", f"{cert}.subjectName")).alias("subject"), of("certificate", _text("c", f"{cert}.issuerName")).alias("issuer"), of("certificate", _text("c", f"{cert}.notValidBefore")).alias("not_before"), of("certificate", _text("c", f"{cert}.notValidAfter")).alias("not_after"), of("certificate", _text("c", f"{cert}.certificateFormat")).alias("certificate_format"),
        of("related-crypto-material", _text("c", f"{material}.type")).alias("material"), of("related-crypto-material", _text("c", f"{material}.state")).alias("state"), of("related-crypto-material", _int("c", f"{material}.size")).alias("material_size"),
        posture.alias("quantum_status"), F.when(has, F.when(posture == "broken", "critical").when(posture == "vulnerable", "medium").otherwise("info")).alias("severity"))
