"""Maintenance log, parts, technicians, budget and schedule queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plantpulse.functions.dates import as_date, quarter_label
from plantpulse.functions.numeric import half_up, ratio, ratio_or_null
from plantpulse.functions.text import note_preview
from plantpulse.operators.joins import place_assets
from plantpulse.operators.latest import first_rows, top_rows
from plantpulse.operators.shape import count_matrix
from plantpulse.operators.shares import growth, with_previous, with_share
from plantpulse.sources.dimensions import repeat_rows, spine_by_bounds
from plantpulse.warehouse import Warehouse

Day = dt.date | str
LOG = "fct_maintenance_log"
PARTS = "fct_maintenance_parts_used"
EMERGENCY, PREDICTIVE, PREVENTIVE, INSPECTION = 1, 2, 3, 4


def cost() -> Column:
    return F.col("parts_cost") + F.col("labor_cost")


def total_cost(into: str = "total_cost") -> Column:
    return F.sum(cost()).cast("double").alias(into)


def with_type(wh: Warehouse, rows: DataFrame) -> DataFrame:
    """Adds the type name."""
    return rows.join(wh["dim_work_order_type"], "wo_type_id")


def per_place(wh: Warehouse, per_asset: DataFrame, place: list[str]) -> DataFrame:
    """Joins rows already reduced per asset to their place."""
    return per_asset.join(place_assets(wh.current_assets(), wh, place), "asset_id")


def maintenance_cost_by_type(wh: Warehouse) -> DataFrame:
    sums = wh[LOG].groupBy("wo_type_id").agg(total_cost())
    return with_share(with_type(wh, sums).select("wo_type_name", "total_cost"), "total_cost", "share")


def maintenance_history(wh: Warehouse, as_of: Day, days: int = 30, asset_id: int | None = None,
                        limit: int = 20) -> DataFrame:
    """Most recent work orders; the limit is taken before the dimension joins."""
    rows = wh.last_days(LOG, as_of, days)
    if asset_id is not None:
        rows = rows.filter(F.col("asset_id") == asset_id)
    recent = top_rows(rows, [F.col("completed_date").desc(), F.col("log_id")], limit)
    named = with_type(wh, recent).join(wh.current_assets().select("asset_id", "asset_name"), "asset_id")
    return named.select("log_id", "asset_name", "completed_date", "wo_type_name",
                        F.col("downtime_hours").cast("double").alias("downtime_hours"),
                        cost().cast("double").alias("total_cost"),
                        note_preview(F.col("technician_notes")).alias("notes"), "failure_flag")


def maintenance_history_asset(wh: Warehouse, asset_id: int, start: Day, end: Day) -> DataFrame:
    """Work orders of one asset with type, technician and failure text (both optional)."""
    rows = wh.between(LOG, start, end).filter(F.col("asset_id") == asset_id)
    codes = wh["dim_failure_code"].select("failure_code_id", "failure_description")
    people = wh["dim_technician"].select("technician_id", "technician_name")
    return (with_type(wh, rows).join(people, "technician_id", "left").join(codes, "failure_code_id", "left")
            .select("log_id", "completed_date", F.col("downtime_hours").cast("double").alias("downtime_hours"),
                    F.col("parts_cost").cast("double").alias("parts_cost"),
                    F.col("labor_cost").cast("double").alias("labor_cost"), "failure_flag", "wo_type_name",
                    "technician_name", "failure_description", "technician_notes")
            .orderBy(F.col("completed_date").desc(), "log_id"))


def maintenance_summary(wh: Warehouse, start: Day, end: Day) -> DataFrame:
    """Per asset: downtime, cost and failures in a date range."""
    return wh.between(LOG, start, end).groupBy("asset_id").agg(
        F.sum("downtime_hours").cast("double").alias("total_downtime"), total_cost(),
        F.count_if("failure_flag").alias("failure_events"))


def maintenance_roi(wh: Warehouse) -> DataFrame:
    """Return of planned work per plant: (emergency cost - planned cost) / planned cost, zero guarded."""
    planned = F.sum(F.when(F.col("wo_type_id") != EMERGENCY, cost()))
    emergency = F.sum(F.when(F.col("wo_type_id") == EMERGENCY, cost()))
    per_asset = wh[LOG].groupBy("asset_id").agg(planned.alias("c"), emergency.alias("a"))
    sums = per_place(wh, per_asset, ["plant_name"]).groupBy("plant_name").agg(F.sum("c").alias("c"), F.sum("a").alias("a"))
    return sums.select("plant_name", F.col("c").cast("double").alias("program_cost"),
                       F.col("a").cast("double").alias("cost_avoidance"),
                       half_up(ratio(F.col("a") - F.col("c"), F.col("c")), 6).alias("roi"))


# Technicians -------------------------------------------------------------------------------

def _per_technician(wh: Warehouse, rows: DataFrame) -> DataFrame:
    sums = rows.groupBy("technician_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum("labor_cost").alias("labor"),
        F.count_if(F.col("wo_type_id") == PREVENTIVE).alias("preventive"),
        F.count_if(F.col("wo_type_id") == EMERGENCY).alias("emergency"),
        F.countDistinct("asset_id").alias("assets"))
    return sums.join(wh["dim_technician"].select("technician_id", "technician_name", "craft", "shift"), "technician_id")


def technician_workload(wh: Warehouse) -> DataFrame:
    return _per_technician(wh, wh[LOG]).select("technician_id", "technician_name", "orders")


def technician_units(wh: Warehouse, year: int) -> DataFrame:
    """Orders and distinct assets per technician in a year."""
    rows = wh.between(LOG, f"{year}-01-01", f"{year}-12-31")
    return _per_technician(wh, rows).select("technician_id", "technician_name", "orders", "assets")


def top_technician(wh: Warehouse, year: int, limit: int = 1) -> DataFrame:
    return top_rows(technician_units(wh, year).select("technician_id", "technician_name", "orders"),
                    [F.col("orders").desc(), F.col("technician_id")], limit)


def labor_by_craft(wh: Warehouse) -> DataFrame:
    """Mean labour cost per order by craft, ranked."""
    sums = _per_technician(wh, wh[LOG]).groupBy("craft").agg(F.sum("labor").alias("l"), F.sum("orders").alias("n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("mean_labor_cost").desc(), F.col("craft"))
    return sums.select("craft", half_up(ratio(F.col("l"), F.col("n")), 4).alias("mean_labor_cost")).withColumn(
        "rank_no", F.rank().over(w).cast("bigint"))


def activities_by_shift(wh: Warehouse) -> DataFrame:
    """Mean orders per technician, by shift."""
    sums = _per_technician(wh, wh[LOG]).groupBy("shift").agg(
        F.sum("orders").alias("orders"), F.count(F.lit(1)).alias("technicians"))
    return sums.select("shift", "orders", "technicians",
                       half_up(ratio(F.col("orders"), F.col("technicians")), 4).alias("orders_per_technician"))


def evening_shift_orders(wh: Warehouse, as_of: Day, days: int = 30, shift: str = "Evening") -> DataFrame:
    people = wh["dim_technician"].filter(F.col("shift") == shift).select("technician_id", "shift")
    counts = wh.last_days(LOG, as_of, days).groupBy("technician_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(people, "technician_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orders"))


def technician_type_matrix(wh: Warehouse) -> DataFrame:
    names = {EMERGENCY: "emergency", PREDICTIVE: "predictive", PREVENTIVE: "preventive", INSPECTION: "inspection"}
    counts = count_matrix(wh[LOG], ["technician_id"], "wo_type_id", names)
    return counts.join(wh["dim_technician"].select("technician_id", "technician_name"), "technician_id")


def prevention_ratio(wh: Warehouse, limit: int = 10) -> DataFrame:
    """Technicians with the most preventive per emergency order; NULL without an emergency."""
    rate = _per_technician(wh, wh[LOG]).select(
        "technician_id", "technician_name", "preventive", "emergency",
        half_up(ratio_or_null(F.col("preventive"), F.col("emergency")), 6).alias("prevention_ratio"))
    return top_rows(rate, [F.col("prevention_ratio").desc_nulls_last(), F.col("technician_id")], limit)


# Types, places, periods --------------------------------------------------------------------

def emergency_orders(wh: Warehouse, as_of: Day, days: int = 30) -> DataFrame:
    rows = wh.last_days(LOG, as_of, days).filter(F.col("wo_type_id") == EMERGENCY)
    return rows.agg(F.count(F.lit(1)).alias("orders"))


def downtime_by_type(wh: Warehouse) -> DataFrame:
    sums = wh[LOG].groupBy("wo_type_id").agg(F.sum("downtime_hours").alias("h"), F.count(F.lit(1)).alias("n"))
    return with_type(wh, sums).select("wo_type_name", half_up(ratio(F.col("h"), F.col("n")), 4).alias("mean_downtime"))


def planned_unplanned_downtime(wh: Warehouse) -> DataFrame:
    """Mean downtime of planned and unplanned orders and the difference."""
    planned = F.col("wo_type_id") != EMERGENCY
    sums = wh[LOG].agg(
        F.sum(F.when(planned, F.col("downtime_hours"))).alias("ph"), F.count_if(planned).alias("pn"),
        F.sum(F.when(~planned, F.col("downtime_hours"))).alias("uh"), F.count_if(~planned).alias("un"))
    p, u = ratio(F.col("ph"), F.col("pn")), ratio(F.col("uh"), F.col("un"))
    return sums.select(half_up(p, 4).alias("planned_mean"), half_up(u, 4).alias("unplanned_mean"),
                       half_up(u - p, 4).alias("difference"))


def planned_unplanned_ratio(wh: Warehouse) -> DataFrame:
    per_asset = wh[LOG].groupBy("asset_id").agg(
        F.count_if(F.col("wo_type_id") != EMERGENCY).alias("p"), F.count_if(F.col("wo_type_id") == EMERGENCY).alias("u"))
    sums = per_place(wh, per_asset, ["plant_name"]).groupBy("plant_name").agg(F.sum("p").alias("planned"), F.sum("u").alias("unplanned"))
    return sums.withColumn("ratio", half_up(ratio_or_null(F.col("planned"), F.col("unplanned")), 6))


def failures_vs_preventive(wh: Warehouse) -> DataFrame:
    return wh[LOG].agg(F.count_if("failure_flag").alias("failures"),
                       F.count_if(F.col("wo_type_id") == PREVENTIVE).alias("preventive_actions"))


def downtime_by_line(wh: Warehouse, as_of: Day, days: int = 30) -> DataFrame:
    per_asset = wh.last_days(LOG, as_of, days).groupBy("asset_id").agg(F.sum("downtime_hours").alias("h"))
    return per_place(wh, per_asset, ["line_name"]).groupBy("line_name").agg(F.sum("h").cast("double").alias("downtime_hours"))


def downtime_in_month(wh: Warehouse, first: Day, last: Day) -> DataFrame:
    return wh.between(LOG, first, last).agg(F.sum("downtime_hours").cast("double").alias("downtime_hours"),
                                            F.count(F.lit(1)).alias("orders"))


def top_failure_codes(wh: Warehouse, year: int, limit: int = 5) -> DataFrame:
    rows = wh.between(LOG, f"{year}-01-01", f"{year}-12-31").filter(F.col("failure_code_id").isNotNull())
    counts = rows.groupBy("failure_code_id").agg(F.count(F.lit(1)).alias("orders"))
    top = top_rows(counts, [F.col("orders").desc(), F.col("failure_code_id")], limit)
    codes = wh["dim_failure_code"].select(
        "failure_code_id", "failure_hierarchy_1", "failure_hierarchy_2", "failure_hierarchy_3")
    return top.join(codes, "failure_code_id")


def failure_hierarchy(wh: Warehouse) -> DataFrame:
    """Failure orders by the three code levels with subtotals; joined after the count per code."""
    counts = wh[LOG].filter(F.col("failure_code_id").isNotNull()).groupBy("failure_code_id").agg(F.count(F.lit(1)).alias("n"))
    levels = ["failure_hierarchy_1", "failure_hierarchy_2", "failure_hierarchy_3"]
    return counts.join(wh["dim_failure_code"], "failure_code_id").rollup(*levels).agg(
        F.sum("n").alias("orders"), F.grouping_id().cast("int").alias("level"))


def failure_rate_by_process(wh: Warehouse, limit: int = 10) -> DataFrame:
    per_asset = wh[LOG].groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("failure_flag").alias("f"))
    sums = per_place(wh, per_asset, ["process_name"]).groupBy("process_name").agg(F.sum("n").alias("n"), F.sum("f").alias("f"))
    rate = sums.select("process_name", half_up(ratio(F.col("f"), F.col("n")), 6).alias("failure_rate"))
    return top_rows(rate, [F.col("failure_rate").desc(), F.col("process_name")], limit)


def cost_by_process(wh: Warehouse, first: Day, last: Day) -> DataFrame:
    """Parts plus labour by process in a quarter."""
    per_asset = wh.between(LOG, first, last).groupBy("asset_id").agg(F.sum(cost()).alias("c"))
    return per_place(wh, per_asset, ["process_name"]).groupBy("process_name").agg(F.sum("c").cast("double").alias("total_cost"))


def downtime_impact_by_plant(wh: Warehouse) -> DataFrame:
    """Downtime hours x impact per hour, per plant, highest first."""
    per_asset = wh[LOG].groupBy("asset_id").agg(F.sum("downtime_hours").cast("decimal(12,1)").alias("h"))
    placed = per_place(wh, per_asset, ["plant_name", "downtime_impact_per_hour"])
    return placed.groupBy("plant_name").agg(
        F.sum(F.col("h") * F.col("downtime_impact_per_hour")).cast("double").alias("impact")).orderBy(
        F.col("impact").desc(), "plant_name")


def orders_by_asset_class(wh: Warehouse) -> DataFrame:
    per_asset = wh[LOG].groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"))
    classes = wh.current_assets().select("asset_id", "asset_class_id")
    sums = per_asset.join(classes, "asset_id").groupBy("asset_class_id").agg(F.sum("n").alias("orders"))
    return sums.join(wh["dim_asset_class"], "asset_class_id").select("class_name", "orders")


def emergency_mom(wh: Warehouse) -> DataFrame:
    """Emergency orders per month and the change against the month before; months without any count as 0."""
    some = wh[LOG].filter(F.col("wo_type_id") == EMERGENCY).groupBy(
        F.trunc("completed_date", "month").alias("month_start")).agg(F.count(F.lit(1)).alias("n"))
    months = some.agg(F.explode(F.sequence(F.min("month_start"), F.max("month_start"), F.expr("INTERVAL 1 MONTH"))).alias("month_start"))
    monthly = months.join(some, "month_start", "left").select("month_start", F.coalesce("n", F.lit(0)).cast("bigint").alias("orders"))
    before = with_previous(monthly, "orders", "month_start", "previous", F.add_months("month_start", -1))
    return before.select("month_start", "orders", growth(F.col("orders"), F.col("previous")).alias("change"))


def cost_by_quarter(wh: Warehouse) -> DataFrame:
    """Cost per calendar quarter, ranked."""
    sums = wh[LOG].groupBy(quarter_label(F.col("completed_date")).alias("quarter")).agg(total_cost())
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("total_cost").desc(), F.col("quarter"))
    return sums.withColumn("rank_no", F.rank().over(w).cast("bigint"))


def costliest_quarter(wh: Warehouse) -> DataFrame:
    """Quarter of the year that costs most over all years."""
    sums = wh[LOG].groupBy(F.quarter("completed_date").alias("quarter")).agg(total_cost())
    return top_rows(sums, [F.col("total_cost").desc(), F.col("quarter")], 1)


# Parts -------------------------------------------------------------------------------------

def top_parts(wh: Warehouse, limit: int = 10) -> DataFrame:
    uses = wh[PARTS].groupBy("material_id").agg(
        F.count(F.lit(1)).alias("uses"), F.sum("quantity_used").cast("double").alias("quantity"))
    top = top_rows(uses, [F.col("uses").desc(), F.col("quantity").desc(), F.col("material_id")], limit)
    return top.join(wh["dim_material"].select("material_id", "material_nk"), "material_id")


def _parts_per_order(wh: Warehouse) -> DataFrame:
    """Parts reduced to one row per order, so the join to the log is one to one."""
    return wh[PARTS].groupBy("log_id").agg(F.sum("total_cost").alias("parts_total"), F.sum("quantity_used").alias("quantity"),
                                          F.count(F.lit(1)).alias("parts_rows"))


def parts_cost_by_type(wh: Warehouse, first: Day, last: Day) -> DataFrame:
    """Cost of materials by order type for orders completed in a period."""
    orders = wh.between(LOG, first, last).select("log_id", "wo_type_id")
    sums = orders.join(_parts_per_order(wh), "log_id").groupBy("wo_type_id").agg(F.sum("parts_total").cast("double").alias("parts_cost"))
    return with_type(wh, sums).select("wo_type_name", "parts_cost")


def parts_per_event(wh: Warehouse) -> DataFrame:
    """Mean quantity of parts per order (orders without parts count as zero), by type."""
    rows = wh[LOG].select("log_id", "wo_type_id").join(_parts_per_order(wh), "log_id", "left")
    sums = rows.groupBy("wo_type_id").agg(F.coalesce(F.sum("quantity"), F.lit(0)).alias("q"), F.count(F.lit(1)).alias("n"))
    return with_type(wh, sums).select("wo_type_name", half_up(ratio(F.col("q"), F.col("n")), 4).alias("parts_per_order"))


def supplier_max_cost(wh: Warehouse) -> DataFrame:
    """Supplier of the most expensive part by unit cost."""
    best = wh["dim_material"].groupBy("supplier_name").agg(F.max("unit_cost").cast("double").alias("max_unit_cost"))
    return top_rows(best, [F.col("max_unit_cost").desc(), F.col("supplier_name")], 1)


def spend_on_kind(wh: Warehouse, prefix: str) -> DataFrame:
    """Spend on materials whose key starts with a prefix. Summed per material before the join."""
    kinds = wh["dim_material"].filter(F.col("material_nk").startswith(prefix)).select("material_id")
    sums = wh[PARTS].groupBy("material_id").agg(F.sum("total_cost").alias("c"), F.sum("quantity_used").alias("q"))
    return sums.join(kinds, "material_id", "left_semi").agg(
        F.sum("c").cast("double").alias("total_cost"), F.sum("q").cast("double").alias("quantity"))


def usage_rate(wh: Warehouse) -> DataFrame:
    """Quantity per 30 days of the log's span, for every part used (no stock table exists)."""
    span = wh[LOG].agg((F.datediff(F.max("completed_date"), F.min("completed_date")) + 1).cast("double")).scalar()
    sums = wh[PARTS].groupBy("material_id").agg(F.sum("quantity_used").alias("q"))
    return sums.select("material_id", half_up(F.col("q").cast("double") * 30.0 / span, 6).alias("monthly_usage"))


def bill_of_parts(wh: Warehouse, rules: DataFrame, materials_per_rule: int = 4) -> DataFrame:
    """Parts an order needs: the order repeated per part, material by rule, cost by unit price.

    ``rules`` maps (order type, slot) to a material; slot is (asset + part number) modulo
    ``materials_per_rule``. It is a small fixed table.
    """
    need = wh[LOG].select("log_id", "asset_id", "wo_type_id", (F.lit(5) - F.col("wo_type_id")).alias("parts"))
    rows = repeat_rows(need, "parts", "part_no").withColumn(
        "slot", ((F.col("asset_id") + F.col("part_no")) % materials_per_rule).cast("int"))
    prices = wh["dim_material"].select("material_id", "unit_cost")
    priced = prices.join(rules, "material_id")
    return rows.join(priced, ["wo_type_id", "slot"]).select(
        "log_id", "part_no", "material_id", F.col("quantity").cast("bigint").alias("quantity"),
        (F.col("quantity") * F.col("unit_cost")).cast("double").alias("total_cost"))


def parts_rules(spark: SparkSession, materials_per_rule: int = 4) -> DataFrame:
    """Rule table by formula: type and slot to material number and quantity."""
    return spark.range(4 * materials_per_rule).select(
        (F.floor(F.col("id") / materials_per_rule) + 1).cast("int").alias("wo_type_id"),
        (F.col("id") % materials_per_rule).cast("int").alias("slot"),
        (F.col("id") * 3 % 20 + 1).alias("material_id"), (F.col("id") % 3 + 1).cast("int").alias("quantity"))


# Budget ------------------------------------------------------------------------------------

BUDGET = "fct_budget"


def budget_total(wh: Warehouse, budget_type: str | None = None, year: int | None = None,
                 quarter: int | None = None) -> DataFrame:
    rows = wh[BUDGET]
    for column, value in (("budget_type", budget_type), ("year", year), ("quarter", quarter)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.agg(F.sum("budget_amount").cast("double").alias("budget_amount"))


def budget_share(wh: Warehouse, year: int, budget_type: str) -> DataFrame:
    """Budget of a type per plant with each plant's part of the whole."""
    rows = wh[BUDGET].filter((F.col("year") == year) & (F.col("budget_type") == budget_type))
    sums = rows.groupBy("plant_id").agg(F.sum("budget_amount").cast("double").alias("budget_amount"))
    named = sums.join(wh["dim_plant"].select("plant_id", "plant_name"), "plant_id").drop("plant_id")
    return with_share(named, "budget_amount", "share")


def budget_type_share(wh: Warehouse, year: int) -> DataFrame:
    sums = wh[BUDGET].filter(F.col("year") == year).groupBy("budget_type").agg(
        F.sum("budget_amount").cast("double").alias("budget_amount"))
    return with_share(sums, "budget_amount", "share")


def budget_yoy(wh: Warehouse, budget_type: str) -> DataFrame:
    """Budget per plant and year against the year before."""
    sums = wh[BUDGET].filter(F.col("budget_type") == budget_type).groupBy("plant_id", "year").agg(
        F.sum("budget_amount").cast("double").alias("budget_amount"))
    named = sums.join(wh["dim_plant"].select("plant_id", "plant_name"), "plant_id").drop("plant_id")
    before = with_previous(named, "budget_amount", "year", "previous", F.col("year") - 1, ["plant_name"])
    return before.select("plant_name", "year", "budget_amount", "previous",
                         growth(F.col("budget_amount"), F.col("previous")).alias("growth"))


def budget_spent(wh: Warehouse, as_of: Day) -> DataFrame:
    """Spend of the running year up to the day as a part of the year's budget, per plant."""
    day = dt.date.fromisoformat(str(as_of))
    per_asset = wh.between(LOG, day.replace(month=1, day=1), day).groupBy("asset_id").agg(F.sum(cost()).alias("c"))
    spent = per_place(wh, per_asset, ["plant_name"]).groupBy("plant_name").agg(F.sum("c").cast("double").alias("spent"))
    annual = wh[BUDGET].filter(F.col("year") == day.year).groupBy("plant_id").agg(
        F.sum("budget_amount").cast("double").alias("budget")).join(wh["dim_plant"].select("plant_id", "plant_name"), "plant_id")
    return annual.select("plant_name", "budget").join(spent, "plant_name", "left").select(
        "plant_name", "budget", F.coalesce("spent", F.lit(0.0)).alias("spent"),
        half_up(ratio(F.coalesce("spent", F.lit(0.0)), F.col("budget")), 6).alias("spent_share"))


# Schedule, runtime ---------------------------------------------------------------------------

def maintenance_calendar(wh: Warehouse, start: Day, end: Day, technicians: int = 10) -> DataFrame:
    """Work due per asset and day: preventive every 30 days, inspection every 15, predictive every 20."""
    bounds = wh.current_assets().select("asset_id", as_date(start).alias("a"), as_date(end).alias("b"))
    days = spine_by_bounds(bounds, "a", "b", "1 DAY", "due_date").withColumn("n", F.datediff("due_date", "a"))
    a, n = F.col("asset_id"), F.col("n")
    kind = (F.when(n % 30 == a % 30, PREVENTIVE).when(n % 15 == a % 15, INSPECTION)
            .when(n % 20 == (a * 2) % 20, PREDICTIVE))
    due = days.withColumn("wo_type_id", kind).filter(F.col("wo_type_id").isNotNull())
    return due.select("asset_id", "due_date", "wo_type_id", ((a + n) % technicians + 1).cast("bigint").alias("technician_id"))


def actual_runtime(wh: Warehouse) -> DataFrame:
    """Planned hours less maintenance downtime per asset and day, never below zero.

    Both sides are reduced to one row per (asset, day) first: two orders on a day must
    not double the production of that day.
    """
    planned = wh["fct_production_log"].groupBy("asset_id", F.col("production_date").alias("day")).agg(
        F.sum("planned_runtime_hours").alias("planned"), F.sum("units_scrapped").alias("scrapped"))
    down = wh[LOG].groupBy("asset_id", F.col("completed_date").alias("day")).agg(
        F.sum("downtime_hours").alias("downtime"), F.max("failure_flag").alias("had_failure"))
    zero = F.lit(0).cast("decimal(15,1)")
    planned = planned.withColumn("planned", F.col("planned").cast("decimal(18,4)"))
    joined = planned.join(down, ["asset_id", "day"], "left")
    left = F.col("planned") - F.coalesce("downtime", zero)
    return joined.select("asset_id", "day", F.col("planned").cast("double").alias("planned_hours"),
                         F.coalesce("downtime", zero).cast("double").alias("downtime_hours"),
                         F.greatest(left, F.lit(0)).cast("double").alias("actual_hours"),
                         F.coalesce("had_failure", F.lit(False)).alias("had_failure"), "scrapped")


def scrap_from_failures(wh: Warehouse) -> DataFrame:
    """Units scrapped on days with and without a failure of the asset."""
    return actual_runtime(wh).groupBy("had_failure").agg(F.sum("scrapped").alias("units_scrapped"),
                                                        F.count(F.lit(1)).alias("asset_days"))


def volume_vs_maintenance(wh: Warehouse) -> DataFrame:
    """Units and orders of each line, and their correlation over its quarters.

    A quarter within the line's production span counts as 0 where it has no order or no output; a
    quarter with neither is no point.
    """
    made = wh["fct_production_log"].groupBy("asset_id", quarter_label(F.col("production_date")).alias("quarter")).agg(
        F.sum("units_produced").alias("u"))
    lines = place_assets(wh.production_assets(), wh, ["line_name"])
    units = made.join(lines, "asset_id").groupBy("line_name", "quarter").agg(F.sum("u").alias("units"))
    done = wh[LOG].groupBy("asset_id", quarter_label(F.col("completed_date")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))
    orders = per_place(wh, done, ["line_name"]).groupBy("line_name", "quarter").agg(F.sum("n").alias("orders"))
    span = units.groupBy("line_name").agg(F.min("quarter").alias("a"), F.max("quarter").alias("b"))
    both = units.join(orders, ["line_name", "quarter"], "full").join(span, "line_name").filter(F.col("quarter").between(F.col("a"), F.col("b"))).select(
        "line_name", F.coalesce("units", F.lit(0)).alias("units"), F.coalesce("orders", F.lit(0)).alias("orders"))
    return both.groupBy("line_name").agg(F.sum("units").alias("units"), F.sum("orders").alias("orders"),
                                         half_up(F.corr("units", "orders"), 4).alias("correlation"))


def overdue_preventive(wh: Warehouse, as_of: Day, every_days: int = 30) -> DataFrame:
    """Assets with a longer pause than planned between preventive orders, or since the last one.

    The pause up to ``as_of`` is open and counts; an asset without any such order has paused since its
    installation. Days are deduplicated per asset first, so the window holds calendar days, not orders.
    """
    days = wh.service_log().filter(F.col("wo_type_id") == PREVENTIVE).select("asset_id", "completed_date").distinct()
    w = Window.partitionBy("asset_id").orderBy("completed_date")
    pause = F.datediff("completed_date", F.lag("completed_date").over(w))
    closed = days.withColumn("pause", pause).groupBy("asset_id").agg(F.max("pause").alias("closed"), F.max("completed_date").alias("last"))
    known = wh.current_assets().select("asset_id", "installation_date").join(closed, "asset_id", "full")
    longest = F.greatest("closed", F.datediff(as_date(as_of), F.coalesce("last", "installation_date")))
    return known.select("asset_id", longest.alias("longest_pause")).filter(F.col("longest_pause") > every_days)


def recent_by_asset(wh: Warehouse, n: int = 5) -> DataFrame:
    """The last ``n`` orders of every asset."""
    order = [F.col("completed_date").desc(), F.col("log_id").desc()]
    return first_rows(wh[LOG].select("asset_id", "log_id", "completed_date"), ["asset_id"], order, n).withColumn(
        "row_no", F.col("row_no").cast("bigint"))
