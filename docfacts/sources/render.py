"""Business documents rendered from orders, customers, suppliers and line items, as pages of text lines.

One invoice per order. Every seventeenth order has a flaw, so that each status of extraction occurs:
o_orderkey % 17 = 1: the customer's VAT number has a wrong check digit; 2: a cited invoice stands before the own number;
3: the total stands on the next line; 4: the page was read by OCR; 5: no total; 6: two different totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_TYPE = "accounting.fattura"


def check_digit(ten: Column) -> Column:
    total = F.lit(0)
    for i in range(1, 11):
        d = F.substring(ten, i, 1).cast("int")
        total = total + (d if i % 2 else d * 2 - 9 * (d > 4).cast("int"))
    return ((10 - total % 10) % 10).cast("string")


def vat_of(key: Column, prefix: str) -> Column:
    ten = F.concat(F.lit(prefix), F.lpad(key.cast("string"), 9, "0"))
    return F.concat(ten, check_digit(ten))


def iban_of(key: Column) -> Column:
    """A valid Italian IBAN with the key as account; check digits are 98 - (number mod 97)."""
    account = F.lpad(key.cast("string"), 12, "0")
    # X05428 11101 account, then IT00 as digits: X = 33, I = 18, T = 29
    rest = ((330542811101 % 97 * 10**12 + account.cast("long")) % 97 * 10**6 + 182900) % 97
    return F.concat(F.lit("IT"), F.lpad((98 - rest).cast("string"), 2, "0"), F.lit("X0542811101"), account)


def italian_amount(value: Column) -> Column:
    return F.translate(F.format_number(value.cast("decimal(18,2)"), 2), ",.", ".,")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and all values that its document shows; an item's line is written before items are gathered, where that is compiled.

    Customers are joined to the bare orders, so that items move once and documents stay where their order's key puts them.
    """
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customers = read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    amount = F.col("l_extendedprice").cast("decimal(18,2)")
    written = read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", F.struct("l_linenumber", amount.alias("amount"), F.concat(F.lit("Importo riga: "), italian_amount(amount)).alias("text")).alias("item"))
    items = written.groupBy("o_orderkey").agg(F.min("l_suppkey").alias("suppkey"), F.sort_array(F.collect_list("item")).alias("items"))
    return orders.join(customers, "o_custkey").join(items, "o_orderkey")


def pages(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, page, text_source, document_type, lines (array of text) of every order's invoice, and what `more` is asked of `invoices`."""
    inv, flaw = invoices(spark, sf_dir), F.col("o_orderkey") % 17
    vat = vat_of(F.col("o_custkey"), "1")
    wrong = F.concat(F.substring(vat, 1, 10), ((F.substring(vat, 11, 1).cast("int") + 1) % 10).cast("string"))
    amount = F.concat(F.lit("EUR "), italian_amount(F.col("o_totalprice")))
    total = F.when(flaw == 5, F.array().cast("array<string>")).when(flaw == 3, F.array(F.lit("Totale documento"), amount)).otherwise(F.array(F.concat(F.lit("Totale documento: "), amount)))
    second = F.when(flaw == 6, F.array(F.concat(F.lit("Totale documento: EUR "), italian_amount(F.col("o_totalprice") + 1))))
    lines = F.concat(
        F.when(flaw == 2, F.array(F.lit("Rif. fattura n. 999000"))).otherwise(F.array().cast("array<string>")),
        F.array(
            F.concat(F.lit("Fattura n. "), F.col("o_orderkey").cast("string")),
            F.concat(F.lit("Data di emissione: "), F.date_format("o_orderdate", "dd/MM/yyyy")),
            F.lit("Fornitore"),
            F.concat(F.lit("Partita IVA: "), vat_of(F.col("suppkey"), "2")),
            F.concat(F.lit("IBAN: "), iban_of(F.col("suppkey"))),
            F.lit("Cliente"),
            F.concat(F.lit("Partita IVA: "), F.when(flaw == 1, wrong).otherwise(vat)),
            F.concat(F.lit("Destinatario: "), F.col("c_name")),
        ),
        F.col("items.text"),
        total,
        F.coalesce(second, F.array().cast("array<string>")),
    )
    source = F.when(flaw == 4, "OCR").otherwise("NATIVE_TEXT")
    drawn = inv.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), source.alias("text_source"), F.lit(DOCUMENT_TYPE).alias("document_type"), *more, lines.alias("drawn"))
    # through a generator, so that filters on the lines don't render them again; over a projection, which is compiled
    return drawn.select("doc_id", "page", "text_source", "document_type", *more, F.explode(F.array("drawn")).alias("lines"))
