"""Domain roles derived from the driver's TESTDATA tables.

The reference reads private warehouse tables; the driver ships a TPC-H-like
star schema instead. These builders derive every domain role from the
given tables with Spark expressions only, so each registered query reads
the whole tables and its work grows with them. The same derivation is
written in DuckDB SQL in :mod:`riskweave.plans.oracle`.

Roles (k = c_custkey, o = o_orderkey):
  tax id       k%5: 0 'A'+8 digits, 1 8 digits+'Z', 2 'X'+7 digits+'L',
               3 9 digits, 4 'CH'+6 digits; every 7th lower-cased and padded
               with spaces, every 41st blank.
  registries   PT ledger c_nationkey%5=0 (PRT), BC ledger k%3<>0 (ESP, with a
               sector code), third ledger all customers (ESP).
  invoices     orders -> three ledgers A/B/C with balances per the fixture
               rule; report date 2001-09-30.
  CRM          events by user_id (newest ts, then event_id).
  rating       client -> request -> evaluation -> link -> statement, all
               derived from customer and orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.operators import ledger as L
from riskweave.operators.joins import lookup_join, snowflake_join
from riskweave.operators.neighbors import wide_join

REPORT_DATE = "2001-09-30"
SOURCE_PRIORITY = {"A": 1, "B": 2, "C": 3}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pad(x: Column, n: int) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def raw_tax_id(k: Column) -> Column:
    base = (F.when(k % 5 == 0, F.concat(F.lit("A"), _pad(k, 8)))
            .when(k % 5 == 1, F.concat(_pad(k, 8), F.lit("Z")))
            .when(k % 5 == 2, F.concat(F.lit("X"), _pad(k, 7), F.lit("L")))
            .when(k % 5 == 3, _pad(k, 9))
            .otherwise(F.concat(F.lit("CH"), _pad(k, 6))))
    return (F.when(k % 41 == 0, F.lit(""))
            .when(k % 7 == 0, F.concat(F.lit(" "), F.lower(base), F.lit(" ")))
            .otherwise(base))


# Test spellings of provinces, one per nation key (0..24), chosen to exercise
# the cleaning rules: map hits, invalid spellings, Portuguese districts,
# title-case edge cases, whitespace and a null.
COUNTY_SPELLINGS = [
    "GIRONA", "San Sebastian", "LONDON", "PORTO", "L'HOSPITALET", " madrid ", "ÁVILA", "CORUÑA, A",
    "BADEN -SUIZA", "FUERTEVENTURA", "lisboa", "Las Palmas", "BIZKAIA", "valencia", "SANT CUGAT DEL VALLÈS",
    "VILA DO CONDE", "S.C. TENERIFE", "GINEBRA", "la rioja", "SETUBAL", "BARCELONA", "TOLEDO",
    "san-juan de alicante", "BE10", None,
]


def county_of(nationkey: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in COUNTY_SPELLINGS]),
                        (nationkey % len(COUNTY_SPELLINGS) + 1).cast("int"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer table with raw tax id and a province spelling from the nation key."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("no_"), raw_tax_id(F.col("c_custkey")).alias("vat_registration_no_"),
                    county_of(F.col("c_nationkey")).alias("county"), F.col("c_nationkey"), F.col("c_mktsegment"),
                    F.col("c_acctbal"))


def registries(spark: SparkSession, sf_dir: str) -> list[L.Registry]:
    c = customers(spark, sf_dir)
    pt = c.filter(F.col("c_nationkey") % 5 == 0).select(
        F.concat(F.lit("PT"), F.col("no_").cast("string")).alias("no_"), "vat_registration_no_", "county")
    bc = c.filter(F.col("no_") % 3 != 0).select(
        F.concat(F.lit("BC"), F.col("no_").cast("string")).alias("no_"), "vat_registration_no_", "county",
        F.concat(_pad(F.col("no_") % 99 + 1, 2), F.lit("11")).alias("att_cnae"))
    ne = c.select(F.concat(F.lit("NE"), F.col("no_").cast("string")).alias("no_"), "vat_registration_no_", "county")
    return [L.Registry(pt, "PRT", 1), L.Registry(bc, "ESP", 2, sector_col="att_cnae"), L.Registry(ne, "ESP", 3)]


def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three invoice ledgers (U1) from orders, balances as decimal(16,2)."""
    o = table(spark, sf_dir, "orders")
    k, st = F.col("o_orderkey"), F.col("o_orderstatus")
    bal = (F.when(k % 50 == 0, F.lit(-100.0))
           .when((st == "O") & (k % 16 == 0), F.col("o_totalprice"))
           .when((st == "P") & (k % 40 == 0), F.lit(1.5))
           .when((st == "F") & (k % 9 == 0), F.lit(0.8))
           .otherwise(F.lit(0.0))).cast("decimal(16,2)")
    issued = F.to_date(F.col("o_orderdate"))
    base = o.select(F.col("o_custkey").alias("customer_no"), k.cast("string").alias("document_no"),
                    F.date_add(issued, 30).cast("string").alias("due_date"),
                    issued.cast("string").alias("posting_date"), bal.alias("bal"), k.alias("_k"))
    a = base.filter(F.col("_k") % 5 != 0).withColumn("remaining_amount", F.col("bal")).withColumn("fuente", F.lit("A"))
    b = (base.filter(F.col("_k") % 4 == 0)
             .withColumn("remaining_amount", (F.col("bal") * F.lit(0.5).cast("decimal(2,1)")).cast("decimal(16,2)"))
             .withColumn("fuente", F.lit("B")))
    c = (base.withColumn("remaining_amount", (F.col("bal") * F.lit(0.25).cast("decimal(3,2)")).cast("decimal(16,2)"))
             .withColumn("fuente", F.lit("C")))
    return L.union_all([x.drop("bal", "_k") for x in (a, b, c)])


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).select("no_", "vat_registration_no_")
    return L.unified_invoices(ledger_entries(spark, sf_dir), c, REPORT_DATE, SOURCE_PRIORITY)


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.customer_master(registries(spark, sf_dir))


def crm_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CRM accounts from events; sector via a lookup join to nation."""
    e = table(spark, sf_dir, "events")
    c = customers(spark, sf_dir).select("no_", "vat_registration_no_")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("sector_id"), F.col("n_name").alias("sector_name"))
    acc = (wide_join(e, c, e.user_id == c.no_)
            .select(F.col("vat_registration_no_").alias("document_number"),
                    (F.col("user_id") % 25).cast("int").alias("sector_id"),
                    F.col("ts").cast("string").alias("incorporation_date"),
                    F.col("ts").alias("last_modified"), F.col("event_id")))
    return lookup_join(acc, n, "sector_id")


def crm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.crm_latest(crm_accounts(spark, sf_dir), "document_number", "last_modified", "event_id",
                        "sector_name", "incorporation_date")


def rating_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    c = customers(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    seg = F.col("c_mktsegment")
    client = c.filter(F.col("no_") % 4 != 1).select(
        F.col("no_").alias("id_cliente"), F.col("vat_registration_no_").alias("cif_nif_raw"),
        F.when(seg == "BUILDING", "PERSON").when(seg == "AUTOMOBILE", "CORPORATE")
         .when(seg == "MACHINERY", "UNKNOWN").alias("tipo_persona"))
    k = F.col("o_orderkey")
    request = o.filter(k % 3 == 0).select(k.alias("id_rating_request"), F.col("o_custkey").alias("id_cliente"),
                                          k.alias("req_evaluacion"))
    evaluation = o.filter(k % 6 == 0).select(
        k.alias("id_evaluacion"),
        F.when(k % 11 == 0, F.lit(None).cast("date")).otherwise(F.to_date("o_orderdate")).alias("fecha_evaluacion"))
    link = o.filter(k % 12 == 0).select(k.alias("link_evaluacion"), (k * 10).alias("id_eeff"))
    statement = o.filter(k % 12 == 0).select(
        (k * 10).alias("st_eeff"),
        F.concat(_pad(k % 97 + 1, 2), F.lit("30")).alias("codigo_cnae"),
        F.date_sub(F.to_date("o_orderdate"), (F.col("o_custkey") % 3650).cast("int")).alias("fecha_constitucion"))
    return {"client": client, "request": request, "evaluation": evaluation, "link": link, "statement": statement}


def rating_chain(t: dict[str, DataFrame]) -> DataFrame:
    """client -> request -> evaluation -> link -> statement."""
    return snowflake_join(t["client"], [(t["request"], "id_cliente", "id_cliente"), (t["evaluation"], "req_evaluacion", "id_evaluacion"),
                                        (t["link"], "id_evaluacion", "link_evaluacion"), (t["statement"], "id_eeff", "st_eeff")])


def rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.rating_latest(rating_chain(rating_tables(spark, sf_dir)))


def customer_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.customer_risk(master(spark, sf_dir), invoices(spark, sf_dir), crm(spark, sf_dir),
                           rating(spark, sf_dir))


# --- rating schema for Q5 / Q6 (k = o_orderkey) -------------------------------------
def rating_schema(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The rating tables of the rating-feature query, derived from TESTDATA.

    evaluation = orders; request = lineitem lines (ids not unique: the
    duplicate (order, line) pairs make ties on MAX(id)); limits = lineitem;
    statements: one per order with k%3=0 plus a newer one when k%6=0;
    Portuguese statements for k%9=0 (a newer one when k%18=0); live risk =
    orders by month (ties kept); offers from events.
    """
    o = table(spark, sf_dir, "orders")
    li = table(spark, sf_dir, "lineitem")
    k = F.col("o_orderkey")
    d = F.to_date("o_orderdate")
    c = customers(spark, sf_dir)
    seg = F.col("c_mktsegment")
    t = {}
    t["evaluation"] = o.select(k.alias("id_evaluacion"), F.col("o_orderdate").alias("fecha_creacion"),
                               (k % 13).cast("int").alias("id_estado_moroso"))
    t["request"] = (li.join(o.select("o_orderkey", "o_custkey"), li.l_orderkey == o.o_orderkey)
                      .select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id_rating_request"),
                              F.col("l_orderkey").alias("id_evaluacion"), F.col("o_custkey").alias("id_cliente"),
                              F.col("l_partkey").alias("rating_id"), F.col("l_returnflag").alias("estado"),
                              F.col("l_linestatus").alias("estado_detalle"),
                              F.when(F.col("l_linestatus") == "O", "TRUE").otherwise("FALSE").alias("last_request"),
                              F.when(F.col("l_linenumber") == 7, F.col("l_suppkey")).alias("id_input_custom_data"),
                              F.round(F.col("l_tax") * 100).cast("int").alias("grade"),
                              F.col("l_discount").alias("pd")))
    t["client"] = c.select(F.col("no_").alias("id_cliente"), F.col("vat_registration_no_").alias("cif_nif"),
                           F.col("county").alias("zona_geografica"),
                           F.when(seg == "BUILDING", "PERSON").when(seg == "AUTOMOBILE", "CORPORATE")
                            .when(seg == "MACHINERY", "UNKNOWN").alias("tipo_persona"))
    t["model_response"] = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rating_id"), (F.col("p_size").cast("double") / 1000.0).alias("pd_new"))
    t["limits_neg"] = li.select(F.col("l_orderkey").alias("id_evaluacion"),
                                (F.col("l_linenumber") % 3).cast("int").alias("id_tramo"),
                                F.col("l_returnflag").alias("id_negocio"), F.col("l_quantity").alias("volumen"),
                                F.col("l_extendedprice").alias("volumen_maximo"), F.col("l_discount").alias("precio"))
    t["limits_ge"] = o.filter(k % 2 == 0).select(k.alias("id_evaluacion"),
                                                 F.col("o_totalprice").alias("limite_total_concedido"),
                                                 (F.col("o_totalprice") / 4).alias("limite_disponible_ge"))
    n = table(spark, sf_dir, "nation")
    t["estado_moroso"] = n.filter(F.col("n_nationkey") < 13).select(
        F.col("n_nationkey").cast("int").alias("id_estado_moroso"), (F.col("n_regionkey") == 0).alias("concurso"),
        (F.col("n_regionkey") == 1).alias("burofax"), (F.col("n_nationkey") * 100.0).alias("deuda_asnef"),
        (F.col("n_regionkey") > 2).alias("asnef"))

    def eeff(s: int, cond: Column) -> DataFrame:
        p = F.col("o_totalprice")
        return o.filter(cond).select(
            (k * 10 + s).alias("id_eeff"), k.alias("id_evaluacion"),
            F.concat(_pad((k + s) % 97 + 1, 2), F.lit("20")).alias("codigo_cnae"),
            (p / (8 * s)).alias("gastos_financieros"), (p * s).alias("ing_explotacion"),
            (p / 2 - 100 * s).alias("result_antes_imp"), p.alias("importe_neto"), (p * 3).alias("total_pasivo"),
            (p - 1000 * s).alias("fondos_propios"), F.date_add(d, 30 * s).alias("fecha_balance"),
            F.date_sub(d, (F.col("o_custkey") % 3650).cast("int")).alias("fecha_constitucion"),
            F.date_add(d, s).alias("fecha_contratacion"))
    t["eeff"] = eeff(1, k % 3 == 0).unionByName(eeff(2, k % 6 == 0))

    def eeff_pt(s: int, cond: Column) -> DataFrame:
        p = F.col("o_totalprice")
        accts = ["capital_realizado", "acoes_propias", "outros_inst_cap_propio", "premios_emissao",
                 "reservas_legais", "outras_reservas", "result_transitados", "resultado_liquido",
                 "dividendos_antecipados"]
        return o.filter(cond).select(
            (k * 10 + 4 + s).alias("id_eeff_pt"), (k * 10 + 1).alias("id_eeff"),
            (p / 4).alias("result_antes_imp_pt"), d.alias("fecha_balance_pt"), (p * 2).alias("total_pasivo_pt"),
            F.date_sub(d, 400 * s).alias("fecha_constitucion_pt"), (p * 10).alias("importe_neto_pt"),
            *[(p * (j + s)).alias(a) for j, a in enumerate(accts)],
            (p * 10).alias("vendas_e_serv_prestados"), F.lit(5.0 * s).alias("outros_rendimentos"),
            F.lit(1.5).alias("juros_e_rend_obtidos"), (p / 16).alias("juros_e_gastos_suport"))
    t["eeff_pt"] = eeff_pt(1, k % 9 == 0).unionByName(eeff_pt(2, k % 18 == 0))
    t["risk"] = o.select(F.col("o_custkey").alias("id_cliente"), F.trunc(d, "month").alias("fecha_creacion"),
                         F.col("o_totalprice").alias("riesgo_power"), (F.col("o_totalprice") / 2).alias("riesgo_gas"),
                         (F.col("o_totalprice") / 8).alias("riesgo_power_falcon"),
                         (k % 7).cast("double").alias("riesgo_eficiencia"),
                         (k % 1000).cast("double").alias("volumen"))
    crm_q, falcon_q = quote_sources(spark, sf_dir)
    from riskweave.operators.rating import offers
    t["offers"] = offers(crm_q, falcon_q)
    return t


def quote_sources(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two offer sources from events (one quote line per event)."""
    e = table(spark, sf_dir, "events")
    eid, et, v = F.col("event_id"), F.col("event_type"), F.col("value")
    base = [eid.cast("string").alias("oferta"), F.col("ts").alias("fecha_oferta"),
            F.col("user_id").alias("rating_id_crm_falcon"),
            F.when(v > 50, F.concat(F.lit("ES"), (eid % 97).cast("string"))).alias("cups"),
            F.when(et == "purchase", F.concat(F.lit("C"), eid.cast("string"))).alias("contrato"),
            F.col("user_id").cast("string").alias("id_cliente_falcon_crm")]
    crm = e.filter(et.isin("purchase", "click")).select(
        *base, F.lit(None).cast("string").alias("ciudad_oferta"), F.lit(None).cast("string").alias("codigo_postal_oferta"),
        (F.floor(v).cast("long") % 40).cast("string").alias("estado"))
    falcon = e.filter(et.isin("view", "signup")).select(
        *base, F.concat(F.lit("CITY_"), (F.col("user_id") % 7).cast("string")).alias("ciudad_oferta"),
        F.lpad((F.col("user_id") % 100).cast("string"), 5, "0").alias("codigo_postal_oferta"),
        F.lpad((F.floor(v).cast("long") % 10).cast("string"), 2, "0").alias("estado"))
    return crm, falcon


def payment_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Ledger entries (ledger A), customers, invoice and credit-memo headers."""
    ent = ledger_entries(spark, sf_dir).filter(F.col("fuente") == "A")
    cus = customers(spark, sf_dir).select("no_", "vat_registration_no_", "c_mktsegment")
    o = table(spark, sf_dir, "orders").join(cus, F.col("o_custkey") == F.col("no_"))
    d = F.to_date("o_orderdate")
    inv = o.filter(F.col("o_orderkey") % 2 == 0).select(
        F.col("o_orderkey").cast("string").alias("factura"), F.col("vat_registration_no_").alias("nif"),
        F.date_add(d, 1).cast("string").alias("hdr_posting_date"))
    memo = o.filter(F.col("o_orderkey") % 50 == 0).select(
        F.col("o_orderkey").cast("string").alias("factura"), F.col("vat_registration_no_").alias("nif"),
        F.date_add(d, 2).cast("string").alias("hdr_posting_date"))
    ids = cus.filter(F.col("c_mktsegment") == "BUILDING").select(F.col("vat_registration_no_").alias("nif"))
    return {"entries": ent, "customers": cus.select("no_", "vat_registration_no_"), "invoices": inv,
            "memos": memo, "ids": ids}
