"""Windows, correlated-subquery rewrites and sampling."""

from pyspark.sql import functions as F

from riskweave.operators import dedupe as D
from riskweave.operators import ledger as L


def test_invoice_priority_and_issue_date(spark):
    # one invoice in 1, 2 and 3 ledgers; the same number with two issue dates
    ent = spark.createDataFrame([
        (1, "F1", "2026-01-10", "2026-01-01", 10.0, "C"), (1, "F1", "2026-01-10", "2026-01-01", 20.0, "B"),
        (1, "F1", "2026-01-10", "2026-01-01", 30.0, "A"), (1, "F2", "2026-01-10", "2026-01-01", 5.0, "C"),
        (1, "F2", "2026-02-10", "2026-02-01", 6.0, "C"), (2, "F3", "2026-01-10", "2026-01-01", 7.0, "B")],
        "customer_no long, document_no string, due_date string, posting_date string, remaining_amount double, fuente string")
    cus = spark.createDataFrame([(1, " a28123456 "), (2, "")], "no_ long, vat_registration_no_ string")
    inv = L.unified_invoices(ent, cus, "2026-03-01", {"A": 1, "B": 2, "C": 3})
    rows = sorted((r.numero_factura, r.fecha_emision, float(r.saldo_pendiente)) for r in inv.collect())
    assert rows == [("F1", "2026-01-01", 30.0), ("F2", "2026-01-01", 5.0), ("F2", "2026-02-01", 6.0)]
    agg = L.invoice_counts(inv).collect()[0]
    assert agg.n_facturas_totales == 2  # COUNT(DISTINCT number)


def test_thresholds_are_strict(spark):
    rows = [("c", f"n{i}", d, b) for i, (d, b) in enumerate(
        [(60, 5000.0), (61, 2000.0), (61, 2000.01), (90, 5.0), (91, 1.0), (91, 1.01), (200, 0.0), (200, -1.0)])]
    inv = spark.createDataFrame(rows, "cif_nif string, numero_factura string, dias_vencido int, saldo double") \
        .withColumn("saldo_pendiente", F.col("saldo").cast("decimal(16,2)")) \
        .withColumn("fecha_vencimiento", F.lit("x")).withColumn("mes_ano_emision", F.lit("x"))
    bad = sorted(r.numero_factura for r in L.delinquent_invoices(inv).collect())
    assert bad == ["n2", "n5"]


def test_latest_request_filter_after_max(spark):
    req = spark.createDataFrame([(1, 10, "TRUE", None), (1, 11, "FALSE", None), (2, 20, "TRUE", None),
                                 (2, 19, "TRUE", None), (3, 30, "TRUE", 7)],
                                "ev int, id int, last_request string, custom int")
    keep = (F.col("last_request") == "TRUE") & F.col("custom").isNull()
    got = sorted((r.ev, r.id) for r in D.latest_request(req, "ev", "id", keep).collect())
    assert got == [(2, 20)]  # ev 1's newest fails the filter; ev 3 has custom input


def test_latest_per_key_keeps_ties(spark):
    df = spark.createDataFrame([(1, "2026-01", 1.0), (1, "2026-02", 2.0), (1, "2026-02", 3.0), (2, "2025-12", 4.0)],
                               "k int, d string, v double")
    assert sorted(r.v for r in D.latest_per_key_in(df, "k", "d").collect()) == [2.0, 3.0, 4.0]


def test_stratified_sample_exact_and_partition_free(spark):
    df = spark.range(5000).select(F.col("id"), (F.col("id") % 10 == 0).alias("y"))
    a = D.stratified_sample(df, "id", "y", 300, seed=7)
    b = D.stratified_sample(df.repartition(13), "id", "y", 300, seed=7)
    ra, rb = sorted(r.id for r in a.collect()), sorted(r.id for r in b.collect())
    assert ra == rb and len(ra) == 300
    assert sum(1 for r in a.collect() if r.y) == 30
