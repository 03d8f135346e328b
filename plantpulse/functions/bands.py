"""Business rules of the dashboards as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plantpulse.functions.numeric import clamp, half_up, ratio

# Fixed values of the business rules.
STANDARD_PERFORMANCE = 0.95
HOURS_PER_DAY = 24
CYCLES_PER_HOUR = 50
NEVER_DAYS = 999
DEFAULT_HEALTH_01 = 0.8
DEFAULT_PROBABILITY = 0.05
DEFAULT_RUL_DAYS = 180
DEFAULT_DOWNTIME_COST = 5000


def availability(planned: Column, actual: Column) -> Column:
    return ratio(actual, planned)


def quality(produced: Column, scrapped: Column) -> Column:
    return ratio(produced - scrapped, produced)


def oee(planned: Column, actual: Column, produced: Column, scrapped: Column,
        performance: float = STANDARD_PERFORMANCE) -> Column:
    """Availability x performance x quality of summed inputs; any zero base gives 0.0."""
    return availability(planned, actual) * F.lit(performance) * quality(produced, scrapped)


def production_at_risk(probability: Column, impact_per_hour: Column) -> Column:
    """Expected loss of one day of downtime, in exact decimal."""
    return probability.cast("decimal(3,2)") * impact_per_hour.cast("decimal(12,2)") * F.lit(HOURS_PER_DAY)


def roi(cost: Column, avoidance: Column) -> Column:
    return ratio(avoidance - cost, cost)


def health_band(score: Column) -> Column:
    return (F.when(score >= 90, "excellent").when(score >= 75, "attention")
            .when(score.isNotNull(), "immediate"))


def tool_health_status(score: Column) -> Column:
    return F.when(score >= 90, "healthy").when(score >= 70, "warning").when(score.isNotNull(), "critical")


def health_colour(score01: Column) -> Column:
    return F.when(score01 > 0.8, "green").when(score01 > 0.5, "yellow").when(score01.isNotNull(), "red")


def risk_level(probability: Column) -> Column:
    return (F.when(probability > 0.8, "critical").when(probability > 0.6, "high")
            .when(probability.isNotNull(), "medium"))


def oee_status(percent: Column) -> Column:
    return F.when(percent >= 85, "green").when(percent >= 65, "yellow").when(percent.isNotNull(), "red")


def sensor_status(sensor_type: Column, value: Column) -> Column:
    """Band of a single reading by sensor type; bounds are strict."""
    temperature = F.when(value > 150, "critical").when(value > 100, "warning")
    vibration = F.when(value > 2.0, "critical").when(value > 1.5, "warning")
    pressure = F.when((value > 160) | (value < 120), "warning")
    band = (F.when(sensor_type == "Temperature", temperature)
            .when(sensor_type == "Vibration", vibration)
            .when(sensor_type == "Pressure", pressure))
    return F.when(value.isNotNull(), F.coalesce(band, F.lit("normal")))


def asset_status(health01: Column, anomalous: Column) -> Column:
    """Online / Warning / Critical from 0-1 health; missing inputs take the page defaults."""
    health = F.coalesce(health01, F.lit(DEFAULT_HEALTH_01))
    return (F.when(F.coalesce(anomalous, F.lit(False)) | (health < 0.5), "Critical")
            .when(health < 0.7, "Warning").otherwise("Online"))


def rule_health_score(days: Column, hour: Column, load: Column) -> Column:
    """Rule score: falls with age, hour of day and load, kept within 70..100."""
    return half_up(clamp(F.lit(100.0) - days * F.lit(0.15) - hour * F.lit(0.1) - load, 70.0, 100.0), 2)


def rule_failure_probability(health: Column) -> Column:
    return half_up(clamp((F.lit(100.0) - health) / F.lit(400.0), 0.01, 0.95), 2)


def rule_rul_days(days: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.lit(400.0) - days * F.lit(0.8) + F.lit(0.5)).cast("int"))


def is_anomaly(health: Column, vibration: Column, rotating: Column) -> Column:
    """Low health on any asset, or high vibration on rotating equipment."""
    return F.coalesce(health < 80, F.lit(False)) | F.coalesce(rotating & (vibration > 1.2), F.lit(False))


def cycles_since(days: Column) -> Column:
    return F.greatest(F.lit(0), days * HOURS_PER_DAY * CYCLES_PER_HOUR)
