"""Readers of inventory and component documents, and of file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CBOM = """bomFormat string, serialNumber string, components array<struct<type:string,`bom-ref`:string,name:string,description:string,
cryptoProperties:struct<assetType:string,algorithmProperties:struct<primitive:string,algorithmFamily:string,parameterSetIdentifier:string,mode:string,padding:string,classicalSecurityLevel:int>>,
evidence:struct<occurrences:array<struct<location:string,line:int>>>,properties:array<struct<name:string,value:string>>>>"""
SBOM = """bomFormat string, spdxVersion string, components array<struct<name:string,version:string,purl:string,type:string>>,
packages array<struct<name:string,versionInfo:string,externalRefs:array<struct<referenceType:string,referenceLocator:string>>>>"""


def read_corpus(spark: SparkSession, root: str, max_size: int | None = None, glob: str = "*") -> DataFrame:
    """Files under a root: path, size, content (bytes)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    rows = files.select("path", F.col("length").alias("size"), "content")
    return rows if max_size is None else rows.where(F.col("size") <= max_size)


def read_cbom(spark: SparkSession, path: str) -> DataFrame:
    """CycloneDX components as finding rows: first occurrence, properties as a map, defaults for what is missing."""
    docs = spark.read.schema(CBOM).option("multiLine", "true").json(path)
    c = docs.select(F.col("serialNumber").alias("document"), F.posexplode("components").alias("seq", "c"))
    props = F.map_from_entries(F.coalesce("c.properties", F.array().cast("array<struct<name:string,value:string>>")))
    out = c.select("document", "seq", F.col("c.`bom-ref`").alias("bom_ref"), F.col("c.name").alias("name"), F.col("c.cryptoProperties").alias("x"), F.get("c.evidence.occurrences", F.lit(0)).alias("o"), props.alias("properties"))
    pick = lambda key, default: F.coalesce(F.element_at("properties", F.lit(key)), F.lit(default))
    family = F.lower(F.coalesce("x.algorithmProperties.algorithmFamily", "x.algorithmProperties.primitive"))
    return out.select("document", "seq", "bom_ref", "name", F.coalesce("x.assetType", F.lit("algorithm")).alias("asset_type"), F.col("o.location").alias("file"), F.col("o.line").alias("line"), pick("severity", "medium").alias("severity"),
                      pick("confidence", "medium").alias("confidence"), pick("quantum_status", "unknown").alias("quantum_status"), F.coalesce(F.element_at("properties", F.lit("rule_id")), F.concat(F.lit("upload-"), "name")).alias("rule_id"), family.alias("family"), "properties")


def read_sbom(spark: SparkSession, path: str) -> DataFrame:
    """Components of CycloneDX or SPDX documents; rows without a name are dropped."""
    docs = spark.read.schema(SBOM).option("multiLine", "true").json(path)
    cyclone = docs.where("components IS NOT NULL").select(F.inline("components")).select("name", "version", "purl", "type")
    purl = lambda refs: F.get(F.filter(refs, lambda r: r.referenceType == "purl"), F.lit(0)).referenceLocator
    spdx = docs.where("components IS NULL AND packages IS NOT NULL").select(F.explode("packages").alias("p")).select(F.col("p.name").alias("name"), F.col("p.versionInfo").alias("version"), purl(F.col("p.externalRefs")).alias("purl"), F.lit("library").alias("type"))
    return cyclone.unionByName(spdx).where("coalesce(name, '') <> ''")


def cbom_documents(findings: DataFrame, key: str = "scan_id") -> DataFrame:
    """One CycloneDX document per scan as JSON text; components are sorted by their reference."""
    component = F.struct(F.col("finding_id").alias("bom-ref"), F.lit("cryptographic-asset").alias("type"), "name", F.struct(F.array(F.struct(F.col("file").alias("location"), "line")).alias("occurrences")).alias("evidence"), F.array(F.struct(F.lit("severity").alias("name"), F.col("severity").alias("value"))).alias("properties"))
    docs = findings.groupBy(key).agg(F.array_sort(F.collect_list(component)).alias("components"))
    return docs.select(key, F.to_json(F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.7").alias("specVersion"), F.lit(1).alias("version"), "components")).alias("value"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """Result rows with the rule's index by first appearance in each scan. Rules meet the findings as one row a scan, so that findings
    that come by scan stay where they are."""
    from keyloom.functions.crypto import sarif_level

    first = findings.groupBy("scan_id", "rule_id").agg(F.min(F.struct("seq", "finding_id")).alias("f"))
    rules = first.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("f", "rule_id"))).alias("rules"))
    index = rules.select("scan_id", F.transform("rules", lambda r, i: F.struct(r["rule_id"].alias("rule_id"), i.alias("at"))).alias("rules"))
    at = F.get(F.filter("rules", lambda r: r["rule_id"].eqNullSafe(F.col("rule_id"))), F.lit(0))["at"]
    return findings.join(index, "scan_id").select("scan_id", "finding_id", "rule_id", at.alias("rule_index"), sarif_level(F.col("severity")).alias("level"))


def write_text(documents: DataFrame, path: str, key: str = "scan_id") -> None:
    documents.write.partitionBy(key).mode("overwrite").text(path)


def write_csv(findings: DataFrame, path: str) -> None:
    findings.select("finding_id", "name", "severity", "status", "asset_type", "file", "line", "rule_id", "created_at").write.mode("overwrite").option("header", "true").csv(path)
