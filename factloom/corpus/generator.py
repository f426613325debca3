"""A deterministic business corpus: relations whose money adds up, with planted trends.

Every value is a hash of (seed, table, id), so any executor makes any row alone, in any
order, at any size.  Money is in whole cents until the end.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Vocabularies.
REGIONS = ("North", "South", "East", "West", "Centre", "Coast", "Hills", "Delta", "Capital")
PERILS = ("water_damage", "fire", "storm", "theft", "collision", "liability")
STATUSES = ("open", "closed", "denied", "reopened", "pending")
PRODUCTS = ("HOME-A", "HOME-B", "AUTO-A", "AUTO-B", "SHOP-A", "SHOP-B")
# Shares of the statuses, in claims of every 12,000.
STATUS_SHARES = (4800, 4200, 600, 1440, 960)
ROWS = {"regions": 9, "products": 6, "adjusters": 24, "customers": 4_000, "policies": 6_000, "claims": 12_000, "payments": 9_000}
#: Planted cells: (month, region, peril) with how many times the usual weight.
PLANTED = ((3, 1, 0, 8), (3, 2, 0, 6), (1, 4, 2, 5), (2, 4, 2, 5), (5, 7, 1, 4), (6, 7, 1, 4), (4, 3, 3, 4), (2, 8, 4, 3))
START = "2026-01-01"


def draw(seed: int, what: str, key: Column, n: int) -> Column:
    """A whole number in [0, n) that depends on seed, name and key alone."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), key), F.lit(n))


def cents(c: Column) -> Column:
    return (c / 100).cast("decimal(18,2)")


def claim_cells() -> list[tuple[int, int, int, int, int]]:
    """(month, region, peril, weight below, weight up to) of the 324 cells."""
    out, total = [], 0
    extra = {(m, r, p): w for m, r, p, w in PLANTED}
    for m in range(1, 7):
        for r in range(1, 10):
            for p in range(len(PERILS)):
                weight = 10 * extra.get((m, r, p), 1)
                out.append((m, r, p, total, total + weight))
                total += weight
    return out


def generate(spark: SparkSession, seed: int = 7, rows: Mapping[str, int] = ROWS) -> dict[str, DataFrame]:
    """regions, products, adjusters, customers, policies, claims and payments.

    incurred = paid + reserve, paid <= incurred, dates run loss <= report <= closed, the
    payments of a claim add up to what it paid, and statuses have exact shares.
    """
    n = dict(ROWS) | dict(rows)
    regions = spark.createDataFrame([(i + 1, name) for i, name in enumerate(REGIONS)], "region_id int, region_name string")
    products = spark.createDataFrame([(i + 1, c, 100_000 * (i + 1), 20_000_000 * (i + 1)) for i, c in enumerate(PRODUCTS)], "product_id int, product_code string, d long, l long")
    ids = lambda name: spark.range(1, n[name] + 1)
    k = F.col("id")
    adjusters = ids("adjusters").select(k.cast("int").alias("adjuster_id"), F.format_string("Adjuster %02d", k).alias("adjuster_name"), (k % 9 + 1).cast("int").alias("region_id"), F.element_at(F.array(*map(F.lit, ("junior", "senior", "lead"))), (k % 3 + 1).cast("int")).alias("seniority"))
    customers = ids("customers").select(k.alias("customer_id"), F.format_string("Customer %06d", k).alias("customer_name"), F.when(draw(seed, "type", k, 4) == 0, "business").otherwise("individual").alias("customer_type"), (draw(seed, "home", k, 9) + 1).cast("int").alias("region_id"))
    policies = (
        ids("policies")
        .select(k.alias("policy_id"), F.format_string("POL-2026-%06d", k).alias("policy_number"), (draw(seed, "holder", k, n["customers"]) + 1).alias("customer_id"), (draw(seed, "product", k, 6) + 1).cast("int").alias("product_id"), F.date_add(F.lit("2025-01-01").cast("date"), draw(seed, "from", k, 540).cast("int")).alias("inception_date"), F.element_at(F.array(*map(F.lit, ("active", "lapsed", "cancelled"))), F.when(draw(seed, "state", k, 10) < 8, 1).otherwise((k % 2 + 2).cast("int"))).alias("status"), (draw(seed, "premium", k, 9_000_000) + 1_000_000).alias("premium"))
        .withColumn("expiry_date", F.date_add("inception_date", 365))
        .withColumn("annual_premium", cents(F.col("premium")))
        .drop("premium")
    )
    cells = claim_cells()
    weight = cells[-1][4]
    table = spark.createDataFrame(cells, "month int, region_id int, peril_no int, low int, high int")  # 324 rows
    base = ids("claims").select(k.alias("claim_id"), draw(seed, "cell", k, weight).cast("int").alias("w"), (draw(seed, "policy", k, n["policies"]) + 1).alias("policy_id"), draw(seed, "order", k, 1 << 40).alias("o"))
    placed = base.join(F.broadcast(table), (F.col("w") >= F.col("low")) & (F.col("w") < F.col("high")))
    key = F.col("claim_id")
    placed = placed.join(policies.select("policy_id", "product_id"), "policy_id").join(F.broadcast(products), "product_id")
    loss = F.date_add(F.add_months(F.lit(START).cast("date"), F.col("month") - 1), draw(seed, "day", key, 28).cast("int"))
    dated = placed.select("claim_id", "policy_id", "region_id", F.element_at(F.array(*map(F.lit, PERILS)), F.col("peril_no") + 1).alias("peril"), loss.alias("date_of_loss"), "o", (draw(seed, "gross", key, 40_000_000) + 500_000).alias("gross"), "d", "l")
    dated = dated.withColumn("report_date", F.date_add("date_of_loss", draw(seed, "wait", key, 20).cast("int"))).withColumn("incurred_c", F.greatest(F.lit(0), F.least(F.col("gross"), F.col("l")) - F.col("d")))
    numbered = _with_status(dated, n["claims"])
    closed = F.col("status").isin("closed", "denied")
    paid = F.when(F.col("status") == "denied", 0).when(F.col("status") == "closed", F.col("incurred_c")).otherwise(F.floor(F.col("incurred_c") * draw(seed, "share", key, 80) / 100).cast("long"))
    claims = numbered.withColumn("paid_c", paid).select(
        "claim_id", F.format_string("CLM-%d", key + 999).alias("claim_number"), "policy_id", F.when(draw(seed, "unassigned", key, 25) > 0, (draw(seed, "adjuster", key, n["adjusters"]) + 1).cast("int")).alias("adjuster_id"), "region_id", "peril", "date_of_loss", "report_date",
        F.when(closed, F.date_add("report_date", draw(seed, "close", key, 60).cast("int"))).alias("closed_date"), "status", cents(F.col("incurred_c")).alias("incurred"), cents(F.col("paid_c")).alias("paid"), cents(F.col("incurred_c") - F.col("paid_c")).alias("reserve"),
    )
    parts = (draw(seed, "parts", key, 3) + 1).cast("int")
    whole = (F.col("paid") * 100).cast("long")
    split = claims.where("paid > 0").select("claim_id", "report_date", whole.alias("c"), parts.alias("parts")).select("*", F.explode(F.sequence(F.lit(1), F.col("parts"))).alias("part"))
    share = F.floor(F.col("c") / F.col("parts")).cast("long")
    payments = split.select(F.concat_ws("-", "claim_id", "part").alias("payment_id"), "claim_id", F.date_add("report_date", 7 * F.col("part")).alias("payment_date"), F.when(F.col("part") == 1, "indemnity").otherwise("expense").alias("payment_type"), cents(F.when(F.col("part") == F.col("parts"), F.col("c") - share * (F.col("parts") - 1)).otherwise(share)).alias("amount"))
    products = products.select("product_id", "product_code", cents(F.col("d")).alias("base_deductible"), cents(F.col("l")).alias("coverage_limit"))
    return {"regions": regions, "products": products, "adjusters": adjusters, "customers": customers, "policies": policies, "claims": claims, "payments": payments}


def _with_status(claims: DataFrame, n: int, buckets: int = 64) -> DataFrame:
    """Exact shares of statuses: ranks by hash order come from counts of hash ranges, not from one sort."""
    ranged = claims.withColumn("bucket", F.floor(F.col("o") / F.lit((1 << 40) // buckets)))
    counts = ranged.groupBy("bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))  # one row per range
    bases = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("base"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("bucket").orderBy("o", "claim_id")) - 1
    edges, status, total = [], F.lit(STATUSES[-1]), sum(STATUS_SHARES)
    for share in STATUS_SHARES:
        edges.append((edges[-1] if edges else 0) + share)
    for name, edge in reversed(list(zip(STATUSES, edges, strict=True))[:-1]):
        status = F.when(F.col("rank") * total < edge * n, name).otherwise(status)
    return ranged.join(F.broadcast(bases), "bucket").withColumn("rank", rank).withColumn("status", status).drop("bucket", "base", "rank", "o")


def write(tables: Mapping[str, DataFrame], folder: str) -> None:
    """Each table as a folder of Parquet files."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def scanned_selection(claims: DataFrame, per_cell: int = 3, first: Column | None = None) -> DataFrame:
    """Of every (peril, month of loss) the first claims by id, those that ``first`` marks before others."""
    order = [F.desc(first)] if first is not None else []
    cell = Window.partitionBy("peril", F.date_format("date_of_loss", "yyyy-MM")).orderBy(*order, "claim_id")
    return claims.withColumn("n", F.row_number().over(cell)).where(F.col("n") <= per_cell).drop("n")


def findings(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Broken rules of a corpus: rule, detail (an id).  An absent table is a finding too."""
    from factloom.operators import checks

    spark = next(iter(tables.values())).sparkSession
    out = [spark.createDataFrame([("absent", t) for t in ROWS if t not in tables], "rule string, detail string")]

    def add(rule: str, rows: DataFrame, key: str) -> None:
        out.append(rows.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("detail")))

    if {"claims", "policies", "payments", "regions"} <= set(tables):
        c, p, pay = tables["claims"], tables["policies"], tables["payments"]
        add("money", checks.SumOf("m", ("incurred", "paid", "reserve")).violations(c), "claim_id")
        add("signs", c.where("incurred < 0 or paid < 0 or reserve < 0"), "claim_id")
        add("dates", c.where("date_of_loss > report_date or report_date > closed_date"), "claim_id")
        add("policy", checks.orphans(c, "policy_id", p, "policy_id"), "claim_id")
        add("region", checks.orphans(c, "region_id", tables["regions"], "region_id"), "claim_id")
        add("unique", checks.duplicates(c, ["claim_number"]), "claim_number")
        add("vocabulary", checks.outside_vocabulary(c, "peril", PERILS), "claim_id")
        sums = pay.groupBy("claim_id").agg(F.sum("amount").alias("s"))
        add("payments", c.join(sums, "claim_id", "left").where("paid <> coalesce(s, 0)"), "claim_id")
    result = out[0]
    for rows in out[1:]:
        result = result.unionByName(rows)
    return result
