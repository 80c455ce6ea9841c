"""The field catalogue: fields with their readers, labels and validators; profiles per document type; overlay of reviewers' decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfacts.functions.text import fold

FIELD_SCHEMA = "field_id string, label string, type string, format string, scale string, cardinality string, pii string, validators array<string>, aliases array<string>"
FIELDS = [
    ("document.number", "Numero documento", "identifier", None, None, "one", "NONE", ["non_empty"], ["fattura n", "numero fattura"]),
    ("document.issue_date", "Data di emissione", "date", None, None, "one", "NONE", ["valid_date"], ["data emissione", "date of issue"]),
    ("issuer.vat_number", "Partita IVA", "identifier", "vat_number", None, "one", "NONE", ["vat_number_format"], ["p iva"]),
    ("recipient.vat_number", "Partita IVA", "identifier", "vat_number", None, "one", "NONE", ["vat_number_format"], ["p iva"]),
    ("recipient.name", "Destinatario", "string", None, None, "one", "PERSONAL", [], ["cliente spett le", "recipient"]),
    ("payment.iban", "IBAN", "identifier", "iban", None, "one", "FINANCIAL", ["iban_checksum"], ["coordinate bancarie"]),
    ("money.total", "Totale documento", "money", None, None, "one", "NONE", ["non_negative_money"], ["importo totale"]),
    ("items.amount", "Importo riga", "money", None, None, "many", "NONE", ["non_negative_money"], []),
]
#: document type, required fields, optional fields
PROFILES = [
    ("accounting.fattura", ["document.number", "document.issue_date", "money.total"], ["issuer.vat_number", "recipient.vat_number", "recipient.name", "payment.iban", "items.amount"]),
    ("accounting.nota_di_credito", ["document.number", "money.total"], ["issuer.vat_number"]),
    ("procurement.preventivo", ["document.number"], ["money.total", "recipient.name"]),
]
#: folded headings of a party's section
SECTIONS = [("issuer", "fornitore"), ("issuer", "cedente"), ("recipient", "cliente"), ("recipient", "cessionario")]


def fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIELDS, FIELD_SCHEMA)


def profiles(spark: SparkSession) -> DataFrame:
    """document_type, field_id, role, ord: a row per field that a type asks for, in order."""
    raw = spark.createDataFrame(PROFILES, "document_type string, required array<string>, optional array<string>")
    roles = F.concat(F.transform("required", lambda f: F.struct(f.alias("field_id"), F.lit("required").alias("role"))), F.transform("optional", lambda f: F.struct(f.alias("field_id"), F.lit("optional").alias("role"))))
    return raw.select("document_type", F.posexplode(roles).alias("ord", "f")).select("document_type", "f.field_id", "f.role", "ord")


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SECTIONS, "party string, heading string")


def missing_references(profile_rows: DataFrame, field_rows: DataFrame) -> DataFrame:
    """Profile rows that name unknown fields; the catalogue is sound if there are none."""
    return profile_rows.join(field_rows.select("field_id"), "field_id", "left_anti")


def apply_overlay(profile_rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Reviewers' decisions (document_type, field_id, state) over the profiles: excluded fields go, others take the role, new ones are added."""
    joined = profile_rows.join(decisions, ["document_type", "field_id"], "full_outer")
    role = F.coalesce("state", "role")
    return joined.select("document_type", "field_id", role.alias("role"), F.coalesce("ord", F.lit(1_000_000)).alias("ord")).where(F.col("role") != "excluded")


def labels(spark: SparkSession, learned: DataFrame | None = None, hints: DataFrame | None = None) -> DataFrame:
    """document_type, field_id, label (folded), tier, words, field attributes: hints, names and aliases are tier 0, learned labels 1 or 2; one row per label, the higher tier wins."""
    f = fields(spark)
    own = f.select("field_id", F.explode(F.concat(F.array("label"), "aliases")).alias("label"))
    own = profiles(spark).join(own, "field_id").select("document_type", "field_id", fold(F.col("label")).alias("label"), F.lit(0).alias("tier"))
    for extra in (hints, learned):
        if extra is not None:
            own = own.unionByName(extra.select("document_type", "field_id", fold(F.col("label")).alias("label"), "tier"))
    best = own.where("label <> ''").groupBy("document_type", "field_id", "label").agg(F.max("tier").alias("tier"))
    return best.join(profiles(spark), ["document_type", "field_id"]).join(f.drop("label", "aliases"), "field_id").withColumn("words", F.size(F.split("label", " ")))
