"""Compliance frameworks by project: FIPS 140-3, PCI DSS 4, CNSA 2.0, the ISO 27001 A.8.24 checklist and the gaps under the EU CRA.

A framework gives every algorithm family a class; a family whose first finding's key is below the least size falls
to the framework's failing class. All of them work on one row per project and family.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.operators.portfolio import compliance_nist

# Class -> family -> least key size (0: none); ``good`` complies, ``small`` is below the size, ``other`` not listed.
FRAMEWORKS = {
    "fips-140-3": {"good": "approved", "small": "not-approved", "other": "not-approved", "classes": {
        "approved": {"aes": 128, "sha256": 0, "sha384": 0, "sha512": 0, "sha3-256": 0, "sha3-384": 0, "sha3-512": 0, "rsa": 2048, "ecdsa": 224, "ecdh": 224, "ecc": 224, "dsa": 2048, "dh": 2048, "ml-kem": 0, "ml-dsa": 0, "slh-dsa": 0, "hash-drbg": 0, "hmac-drbg": 0, "ctr-drbg": 0},
    }},
    "pci-dss-v4": {"good": "compliant", "small": "non-compliant", "other": "unknown", "classes": {
        "compliant": {"aes": 128, "sha256": 0, "sha384": 0, "sha512": 0, "sha3-256": 0, "sha3-384": 0, "sha3-512": 0, "chacha20": 0, "rsa": 2048, "ecdsa": 224, "ecdh": 224, "ecc": 224, "dh": 2048, "ml-kem": 0, "ml-dsa": 0, "slh-dsa": 0, "hash-drbg": 0, "hmac-drbg": 0, "ctr-drbg": 0},
        "non-compliant": {"des": 0, "3des": 0, "rc4": 0, "md5": 0, "md4": 0, "sha1": 0, "math-random": 0, "rand": 0, "blowfish": 0, "dsa": 0},
    }},
    "cnsa-2": {"good": "approved", "small": "not-approved", "other": "not-approved", "classes": {
        "approved": {"aes": 256, "sha384": 0, "sha512": 0, "sha3-384": 0, "sha3-512": 0, "ml-kem": 0, "ml-dsa": 0, "slh-dsa": 0},
        "deprecated": {"rsa": 0, "ecdsa": 0, "ecdh": 0, "ecc": 0, "dh": 0, "dsa": 0},
        "disallowed": {"des": 0, "3des": 0, "rc4": 0, "md5": 0, "md4": 0, "sha1": 0, "blowfish": 0, "math-random": 0, "rand": 0},
    }},
}
#: Requirement of PCI DSS that a family breaks.
PCI_REQUIREMENT = {"des": "2.2.7", "3des": "2.2.7", "rc4": "2.2.7", "md5": "4.2", "md4": "6.2.4", "sha1": "4.2", "math-random": "6.2.4", "rand": "6.2.4", "blowfish": "2.2.7", "dsa": "2.2.7"}
#: Deadlines of CNSA 2.0 by class; families without a class have none.
CNSA_DEADLINE = {"deprecated": "2025", "disallowed": "immediate"}
#: The checklist: families that must be absent, or least key sizes; the other checks are for people to review.
ISO_CHECKS = {
    "A.8.24-3": ("des", "3des", "rc4", "md5", "md4", "sha1"),
    "A.8.24-4": {"rsa": 2048, "dsa": 2048, "dh": 2048, "ecc": 224, "ecdsa": 224, "ecdh": 224, "aes": 128},
    "A.8.24-6": ("math-random", "rand"),
    "A.8.24-7": ("rsa", "ecdsa", "ecdh", "ecc", "dh", "dsa"),
}
ISO_MANUAL = ("A.8.24-1", "A.8.24-2", "A.8.24-5", "A.8.24-8", "A.8.24-9", "A.8.24-10")

# Requirement -> families that must be absent, least key sizes, what to do about those that are found.
CRA_CHECKS = {
    "CRA-ANNEX-I-1": (("des", "3des", "rc4", "md5", "md4", "sha1"), {}, "Replace {} with state-of-the-art algorithms"),
    "CRA-ANNEX-I-2": (("des", "rc4", "md5", "md4"), {}, "Replace {} with state-of-the-art algorithms"),
    "CRA-ANNEX-I-3a": (("des", "3des", "rc4", "blowfish"), {"aes": 128}, "Replace {} with approved encryption (AES-128+, ChaCha20)"),
    "CRA-ANNEX-I-3b": (("md5", "md4", "sha1"), {}, "Replace {} with SHA-256+ or SHA-3"),
    "CRA-ANNEX-I-5": ((), {"rsa": 2048, "ecdsa": 224}, "Increase key sizes for authentication algorithms"),
    "CRA-ANNEX-II-1": ((), {}, ""),
}
CRA_MANUAL = ("CRA-ANNEX-I-3d", "CRA-ANNEX-I-4", "CRA-ANNEX-I-7", "CRA-ANNEX-II-5")


def classify(framework: str, family: Column, size: Column) -> Column:
    """Class of a family under a framework; an unknown size never fails."""
    f = FRAMEWORKS[framework]
    out = F.lit(f["other"])
    for kind, families in f["classes"].items():
        for name, least in families.items():
            out = F.when(family == name, F.when(size < least, f["small"]).otherwise(kind)).otherwise(out)
    return out


def families(findings: DataFrame) -> DataFrame:
    """project_id, family, findings and the key size of the family's first finding."""
    return compliance_nist(findings).select("project_id", "family", "n", "key_size")


def items(findings: DataFrame, framework: str) -> DataFrame:
    """Classes, and what to do, of each project's families; PCI names the requirement, CNSA the deadline."""
    rows = families(findings).withColumn("classification", classify(framework, F.col("family"), F.col("key_size")))
    good = FRAMEWORKS[framework]["good"]
    action = F.when(F.col("classification") == good, "none").when(F.col("classification") == "deprecated", "schedule-migration").otherwise("immediate-remediation")
    out = rows.select("project_id", "family", "n", "classification", action.alias("action"))
    pick = lambda col, table: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col(col)]
    if framework == "pci-dss-v4":
        out = out.withColumn("requirement", F.coalesce(pick("family", PCI_REQUIREMENT), F.lit("")))
    if framework == "cnsa-2":
        out = out.withColumn("deadline", F.coalesce(pick("classification", CNSA_DEADLINE), F.lit("")))
    return out


def scores(findings: DataFrame) -> DataFrame:
    """Share of complying findings of every project under each framework, in one aggregation."""
    ok = {k: F.sum(F.when(classify(k, F.col("family"), F.col("key_size")) == f["good"], F.col("n")).otherwise(0)) for k, f in FRAMEWORKS.items()}
    by = families(findings).groupBy("project_id").agg(F.sum("n").alias("findings"), *(c.alias(k) for k, c in ok.items()))
    each = F.array(*(F.struct(F.lit(k).alias("framework"), F.col(f"`{k}`").alias("compliant")) for k in FRAMEWORKS))
    return by.select("project_id", "findings", F.inline(each)).withColumn("score", F.bround(F.col("compliant") * 100.0 / F.col("findings"), 1))


def iso_failures(family: Column, size: Column) -> list[Column]:
    """For each check of the list, whether a family of that size fails it."""
    return [reduce(or_, ((family == name) & (size < least) for name, least in rule.items())) if isinstance(rule, dict) else family.isin(*rule) for rule in ISO_CHECKS.values()]


def cra_gap_conditions(family: Column, size: Column) -> list[Column]:
    """For each requirement, whether a family of that size is a gap."""
    return [reduce(or_, ((family == name) & (size < least) for name, least in sizes.items()), family.isin(*absent) if absent else F.lit(False)) for absent, sizes, _ in CRA_CHECKS.values()]


def iso_checklist(findings: DataFrame) -> DataFrame:
    """The ten checks of every project: status, findings that count, and the families (or sizes) behind a failure."""
    family, size, n = F.col("family"), F.col("key_size"), F.col("n")
    aggs, checks = [], []
    for i, (check, rule) in enumerate(ISO_CHECKS.items()):
        sizes = isinstance(rule, dict)
        aggs.append(F.sum(F.when(family.isin(*rule), n).otherwise(0)).alias(f"n{i}"))
        for j, name in enumerate(rule):
            said = F.when(size < rule[name], F.concat(F.lit(f"{name}: "), size.cast("string"), F.lit(f" < {rule[name]}"))) if sizes else F.lit(name)
            aggs.append(F.max(F.when(family == name, said)).alias(f"e{i}_{j}"))
        evidence = F.concat_ws("; " if sizes else ", ", *(f"e{i}_{j}" for j in range(len(rule))))
        checks.append(F.struct(F.lit(check).alias("check_id"), F.when(evidence == "", "pass").otherwise("fail").alias("status"), F.col(f"n{i}").alias("findings_count"), evidence.alias("evidence")))
    manual = [F.struct(F.lit(c).alias("check_id"), F.lit("manual-review").alias("status"), F.lit(0).cast("long").alias("findings_count"), F.lit("").alias("evidence")) for c in ISO_MANUAL]
    return families(findings).groupBy("project_id").agg(*aggs).select("project_id", F.inline(F.array(*checks, *manual)))


def cra_gaps(findings: DataFrame) -> DataFrame:
    """The ten requirements of every project: gap, no-gap or manual-review, the families behind a gap and their findings.

    A project with findings has an inventory, so CRA-ANNEX-II-1 is met; one without findings has no rows.
    """
    family, size, n = F.col("family"), F.col("key_size"), F.col("n")
    aggs, checks = [], []
    for i, (requirement, (absent, sizes, advice)) in enumerate(CRA_CHECKS.items()):
        rules = [(name, family == name) for name in absent] + [(name, (family == name) & (size < least)) for name, least in sizes.items()]
        bad = F.lit(False)
        for j, (name, met) in enumerate(rules):
            bad = bad | met
            aggs.append(F.max(F.when(met, name)).alias(f"e{i}_{j}"))
        aggs.append(F.sum(F.when(bad, n).otherwise(0)).alias(f"n{i}"))
        affected = F.concat_ws(", ", *(f"e{i}_{j}" for j in range(len(rules))))
        before, _, after = advice.partition("{}")
        said = F.concat(F.lit(before), affected, F.lit(after)) if "{}" in advice else F.lit(advice)
        checks.append(F.struct(F.lit(requirement).alias("requirement_id"), F.when(affected == "", "no-gap").otherwise("gap").alias("gap_status"), affected.alias("affected"), F.col(f"n{i}").alias("affected_count"), F.when(affected == "", "").otherwise(said).alias("recommendation")))
    manual = [F.struct(F.lit(r).alias("requirement_id"), F.lit("manual-review").alias("gap_status"), F.lit("").alias("affected"), F.lit(0).cast("long").alias("affected_count"), F.lit("Manual review required").alias("recommendation")) for r in CRA_MANUAL]
    return families(findings).groupBy("project_id").agg(*aggs).select("project_id", F.inline(F.array(*checks, *manual)))
