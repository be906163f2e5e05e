"""Tables that grow with the input reach the customer table by shuffles, not through the driver."""

from riskweave.plans import testbed as T

SF = "/root/testdata/sf0.001"


def _broadcasts(df):
    return df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_customers_are_not_broadcast(spark):
    assert _broadcasts(T.invoices(spark, SF)) == 0
    assert _broadcasts(T.crm(spark, SF)) == 1                    # the nation table only


def test_rows_of_the_joins(spark):
    from riskweave.operators.ledger import ledger_join, unified_invoices
    entries = spark.createDataFrame(
        [(1, "a", "2001-01-01", "2000-12-01", "5", "A"), (1, "a", "2001-01-01", "2000-12-01", "7", "B"),
         (2, "b", "2001-01-01", "2000-12-01", "1", "A"), (None, "c", "2001-01-01", "2000-12-01", "1", "A"),
         (9, "d", "2001-01-01", "2000-12-01", "1", "A")],
        "customer_no long, document_no string, due_date string, posting_date string, remaining_amount string, fuente string")
    customers = spark.createDataFrame([(1, " a1 "), (2, "B2"), (2, "C2"), (None, "D4")], "no_ long, vat_registration_no_ string")
    assert ledger_join(entries, customers).count() == 4
    got = unified_invoices(entries, customers, "2001-09-30", {"A": 1, "B": 2}).collect()
    assert sorted((r["cif_nif"], r["fuente"], float(r["saldo_pendiente"])) for r in got) == [
        ("A1", "A", 5.0), ("B2", "A", 1.0), ("C2", "A", 1.0)]
