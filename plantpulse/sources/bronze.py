"""Bronze parsing: JSON documents into typed rows, with the unusable ones kept aside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# JSON field names and types of the three feeds, as target -> (json name, type).
TELEMETRY_FIELDS = {
    "device_id": ("deviceId", "STRING"),
    "metric": ("metric", "STRING"),
    "value": ("value", "DOUBLE"),
    "unit": ("unit", "STRING"),
}
MAINTENANCE_FIELDS = {
    "work_order_id": ("workOrderId", "STRING"),
    "asset_nk": ("assetId", "STRING"),
    "wo_type_code": ("type", "STRING"),
    "notes": ("notes", "STRING"),
    "downtime_hours": ("downtimeHours", "DOUBLE"),
    "labor_cost": ("laborCost", "DOUBLE"),
    "parts_cost": ("partsCost", "DOUBLE"),
    "failure_flag": ("failure", "BOOLEAN"),
    "completed_date": ("date", "DATE"),
}
EQUIPMENT_FIELDS = {
    "serial_number": ("serialNumber", "STRING"),
    "model": ("model", "STRING"),
    "oem_name": ("oem", "STRING"),
    "asset_type": ("assetType", "STRING"),
    "plant_name": ("plant", "STRING"),
    "installation_date": ("installDate", "DATE"),
}

EQUIPMENT_CHANGE_FIELDS: dict[str, tuple[str, str]] = {
    "serial_number": ("serialNumber", "STRING"),
    "model": ("model", "STRING"),
    "oem_name": ("oem", "STRING"),
    "effective_at": ("effectiveAt", "TIMESTAMP_NTZ"),
}

_REJECT = "reject_reason"
_CORRUPT = "_corrupt_record"


def stamp_ingestion(df: DataFrame) -> DataFrame:
    return df.withColumn("ingestion_timestamp", F.current_timestamp())


def parse_variant(df: DataFrame, payload: str, into: str = "document") -> DataFrame:
    """Schema-on-read form: text to VARIANT, NULL where the text is not JSON."""
    return df.withColumn(into, F.try_parse_json(F.col(payload)))


def _parse(raw: DataFrame, payload: str, fields: dict[str, tuple[str, str]], required: tuple[str, ...],
           keep: tuple[str, ...]) -> DataFrame:
    """Parse the text once, cast each field tolerantly, name the first fault of the row.

    Fields are read as text and then ``try_cast``, so a value of the wrong type nulls only
    itself and the row can say which field was at fault.
    """
    schema = ", ".join(f"{json_name} STRING" for json_name, _ in fields.values()) + f", {_CORRUPT} STRING"
    doc = F.from_json(F.col(payload), schema, {"columnNameOfCorruptRecord": _CORRUPT})
    typed: list[Column] = []
    faults = F.when(F.col("__doc").isNull() | F.col(f"__doc.{_CORRUPT}").isNotNull(), F.lit("not json"))
    for name, (json_name, type_name) in fields.items():
        text = F.col(f"__doc.{json_name}")
        value = text.try_cast(type_name)
        typed.append(value.alias(name))
        if name in required:
            faults = faults.when(text.isNull(), F.lit(f"missing {json_name}"))
        if type_name != "STRING":
            faults = faults.when(text.isNotNull() & value.isNull(), F.lit(f"wrong type {json_name}"))
    return (raw.withColumn("__doc", doc)
            .select(*[F.col(c) for c in keep], F.col(payload), *typed, faults.alias(_REJECT)))


def accepted(parsed: DataFrame, payload: str) -> DataFrame:
    return parsed.filter(F.col(_REJECT).isNull()).drop(_REJECT, payload)


def rejected(parsed: DataFrame, payload: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows that could not be used: the original text and why."""
    return parsed.filter(F.col(_REJECT).isNotNull()).select(*keep, payload, _REJECT)


def parse_telemetry(raw: DataFrame, payload: str = "raw_payload",
                    keep: tuple[str, ...] = ("source_timestamp",)) -> DataFrame:
    return _parse(raw, payload, TELEMETRY_FIELDS, ("device_id", "metric", "value"), keep)


def parse_maintenance(raw: DataFrame, payload: str = "log_data", keep: tuple[str, ...] = ()) -> DataFrame:
    return _parse(raw, payload, MAINTENANCE_FIELDS, ("work_order_id", "asset_nk", "completed_date"), keep)


def parse_equipment(raw: DataFrame, payload: str = "equipment_data", keep: tuple[str, ...] = ()) -> DataFrame:
    return _parse(raw, payload, EQUIPMENT_FIELDS, ("serial_number",), keep)


def parse_equipment_changes(raw: DataFrame, payload: str = "equipment_data", keep: tuple[str, ...] = ("ingestion_timestamp",)) -> DataFrame:
    return _parse(raw, payload, EQUIPMENT_CHANGE_FIELDS, ("serial_number", "effective_at"), keep)


def variant_fields(documents: DataFrame, document: str = "document") -> DataFrame:
    """Top-level fields of mixed documents: how many documents hold each, and of which types its values are."""
    found = documents.lateralJoin(_fields_of(documents.sparkSession, document))
    kind = F.regexp_replace(F.schema_of_variant("value"), r"\(.*\)", "")
    return found.groupBy(F.col("key").alias("field")).agg(
        F.count(F.lit(1)).alias("messages"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("types"))


def _fields_of(spark, document: str) -> DataFrame:
    return spark.tvf.variant_explode(F.col(document).outer())


def variant_schema(documents: DataFrame, document: str = "document") -> DataFrame:
    """One row: the schema that holds all documents."""
    return documents.agg(F.schema_of_variant_agg(document).alias("schema"))


def wide_telemetry(long: DataFrame, entity: str, ts: str, metric: str, value: str,
                   columns: dict[str, str]) -> DataFrame:
    """Long metric messages to one row per (entity, ts) with one column per metric.

    ``columns`` maps metric name to output column. The metric list is given, so the pivot
    needs no extra job to discover it, and each output is a partial (map-side) average.
    """
    wanted = long.filter(F.col(metric).isin(list(columns)))
    return wanted.groupBy(entity, ts).agg(*[
        F.avg(F.when(F.col(metric) == m, F.col(value))).alias(out) for m, out in columns.items()
    ])
