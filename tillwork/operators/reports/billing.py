"""Cost reports. ``snapshots`` has day, category, service_name, cost, margin_pct, platform_fee, total_cost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwork.functions.numbers import rounded
from tillwork.operators.features import net_cost, resource_service

# Category of each billed service, category order, and the tax rate.
CATEGORY_OF = {
    "BigQuery": "Data", "Cloud SQL": "Data", "Cloud Dataflow": "Data", "Cloud Storage": "Data",
    "Vertex AI": "Training",
    "Cloud Scheduler": "System", "Secret Manager": "System", "Cloud Build": "System",
    "Artifact Registry": "System", "Cloud Logging": "System",
}
CATEGORIES = ("Data", "Training", "Inference", "System")
CONTAINER_SERVICE, TRAINING_SERVICE = "Cloud Run", "Vertex AI"
VAT_PERCENT = 20
CENTS = "decimal(28,2)"


def _lookup(table: Mapping, key: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def classify(bills: DataFrame, inference_services: Sequence[str], margins: Mapping[str, int], default_margin: int) -> DataFrame:
    """Daily cost per service with category, margin and fee; services that cost nothing are left out.

    ``bills`` has day, service, resource, sku, cost and credits.
    """
    service = F.col("service")
    keyed = bills.select(
        "day", service,
        F.when(service == CONTAINER_SERVICE, resource_service(F.col("resource"))).alias("container"),
        F.coalesce((service == TRAINING_SERVICE) & (F.col("sku").contains("GPU") | F.col("sku").contains("Nvidia")),
                   F.lit(False)).alias("is_gpu"),
        net_cost(F.col("cost"), F.col("credits")).alias("net"))
    daily = keyed.groupBy("day", "service", "container", "is_gpu").agg(F.sum("net").alias("net")).withColumn(
        "cost", F.round("net", 2).cast(CENTS)).where(F.col("cost") > 0)
    inference = F.coalesce((service == CONTAINER_SERVICE) & F.col("container").isin(list(inference_services)), F.lit(False))
    category = F.when(inference, "Inference").when(service == CONTAINER_SERVICE, "System") \
        .otherwise(F.coalesce(_lookup(CATEGORY_OF, service), F.lit("System")))
    name = (
        F.when(inference, F.concat(F.lit(f"{CONTAINER_SERVICE} — "), F.col("container")))
        .when(service == TRAINING_SERVICE, F.concat(service, F.when(F.col("is_gpu"), " — GPU").otherwise(" — CPU")))
        .otherwise(service)
    )
    margin = F.coalesce(_lookup(margins, F.col("service_name")), F.lit(default_margin)) if margins else F.lit(default_margin)
    return (
        daily.select("day", category.alias("category"), name.alias("service_name"), "cost")
        .withColumn("margin_pct", margin)
        .withColumn("platform_fee", F.bround(F.col("cost") * F.col("margin_pct").cast("decimal(10,0)")
                                             / F.lit(100).cast("decimal(10,0)"), 2).cast(CENTS))
        .withColumn("total_cost", (F.col("cost") + F.col("platform_fee")).cast(CENTS))
    )


def _latest_month(snapshots: DataFrame) -> tuple[Column, Column]:
    """First and last day of the latest month of the data."""
    last = snapshots.agg(F.max("day").alias("d"))
    return last.select(F.trunc("d", "month")).scalar(), last.select(F.last_day("d")).scalar()


def invoice(snapshots: DataFrame, rate: float = 1.0, license_fee: float = 0.0, license_discount_pct: float = 0.0) -> DataFrame:
    """The latest month: every service, category totals, subtotal, licence, tax and grand total."""
    first, last = _latest_month(snapshots)
    month = snapshots.where(F.col("day").between(first, last))
    sums = month.rollup("category", "service_name").agg(F.sum("total_cost").alias("t"), F.grouping_id().alias("g")).select(
        F.when(F.col("g") == 0, "service").when(F.col("g") == 1, "category").otherwise("subtotal").alias("line"),
        "category", "service_name", rounded(F.col("t").cast("double") * F.lit(rate), 2).alias("amount"))
    licence = rounded(F.lit(license_fee) * (1 - F.lit(license_discount_pct) / 100), 2)
    net = rounded(F.col("amount") + licence, 2)
    vat = rounded(net * VAT_PERCENT / 100, 2)
    text = F.lit(None).cast("string")
    lines = F.array(*[
        F.struct(F.lit(n).alias("line"), text.alias("category"), text.alias("service_name"), a.alias("amount"))
        for n, a in (("subtotal", F.col("amount")), ("license", licence), ("grand_total", net), ("vat", vat),
                     ("grand_total_with_vat", rounded(net + vat, 2)))
    ])
    # The subtotal row alone grows into the closing lines, so that the month is added up once.
    own = F.array(F.struct("line", "category", "service_name", "amount"))
    return sums.select(F.inline(F.when(F.col("line") == "subtotal", lines).otherwise(own)))


def daily_dense(snapshots: DataFrame) -> DataFrame:
    """Every day of the latest month and every category: NULL for a day without data, 0 for a category
    without cost on a day with data."""
    first, last = _latest_month(snapshots)
    cost = snapshots.where(F.col("day").between(first, last)).groupBy("day", "category").agg(F.sum("total_cost").alias("t"))
    seen = cost.groupBy("day").agg(F.lit(True).alias("_seen"))
    span = snapshots.agg(F.trunc(F.max("day"), "month").alias("a"), F.last_day(F.max("day")).alias("b"))
    grid = span.select(F.explode(F.sequence("a", "b")).alias("day")) \
        .withColumn("category", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])))
    return grid.join(cost, ["day", "category"], "left").join(seen, "day", "left").select(
        "day", "category", F.when(F.col("_seen"), F.coalesce(F.col("t").cast("double"), F.lit(0.0))).alias("total"))


def breakdown(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("category").agg(F.sum("total_cost").cast("double").alias("total")).orderBy(F.col("total").desc())


def cost_per_run(runs: DataFrame, snapshots: DataFrame, service: str, last: int = 10) -> DataFrame:
    """Cost of a service between start and end day of the latest finished runs.

    The range join is an equi join on the day, over the days of each run.
    """
    recent = runs.where(F.col("started_at").isNotNull() & F.col("completed_at").isNotNull()).orderBy(
        F.col("started_at").desc(), F.col("run_id").desc()).limit(last)
    days = recent.select("run_id", F.explode(F.sequence(F.to_date("started_at"), F.to_date("completed_at"))).alias("day"))
    cost = snapshots.where(F.lower("service_name").contains(service.lower())).groupBy("day").agg(
        F.sum("total_cost").alias("t"))
    return days.join(cost, "day").groupBy("run_id").agg(F.sum("t").cast("double").alias("cost"))
