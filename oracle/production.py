"""Production and OEE queries."""

from __future__ import annotations

from oracle.prelude import TODAY, div, r

_P, _A, _U, _S = "sum(planned)", "sum(actual)", "sum(produced)", "sum(scrapped)"
_OEE = f"{div(_A, _P)} * 0.95e0 * {div(f'{_U} - {_S}', _U)}"
_FIGURES = (f"{r(div(_A, _P), 6)} AS availability, 0.95e0 AS performance, "
            f"{r(div(f'{_U} - {_S}', _U), 6)} AS quality, {r(_OEE, 6)} AS oee")
_SUMS = (f"{r(_P, 4)} AS planned_runtime_hours, {r(_A, 4)} AS actual_runtime_hours, "
         f"CAST({_U} AS BIGINT) AS units_produced, CAST({_S} AS BIGINT) AS units_scrapped")
_PLACED = "FROM production JOIN machine_placed USING (asset_id)"


def _last(days: int) -> str:
    return f"production_date BETWEEN {TODAY} - {days} AND {TODAY}"


_DAILY = f"SELECT production_date, {_SUMS}, {_FIGURES} FROM production WHERE {_last(30)} GROUP BY 1"
_DAILY_PLANT = (f"SELECT plant_name, production_date, {_SUMS}, {_FIGURES} {_PLACED} WHERE {_last(30)} GROUP BY 1, 2")

SQL: dict[str, str] = {
    "oee_by_plant": f"SELECT plant_name, {_FIGURES} {_PLACED} GROUP BY 1",
    "oee_by_line": f"SELECT plant_name, line_name, {_FIGURES} {_PLACED} GROUP BY 1, 2",
    "oee_rollup": (f"SELECT plant_name, line_name, CAST(GROUPING(plant_name, line_name) AS INTEGER) AS level, {_FIGURES} "
                   f"{_PLACED} GROUP BY ROLLUP (plant_name, line_name)"),
    "oee_daily_enterprise": _DAILY,
    "oee_daily_plant": _DAILY_PLANT,
    "plant_current": f"SELECT plant_name, {_SUMS} {_PLACED} WHERE {_last(7)} GROUP BY 1",
    "kpi_oee_delta": f""", d AS ({_DAILY}), n AS (SELECT oee, row_number() OVER (ORDER BY production_date DESC) AS k FROM d),
      c AS (SELECT max(CASE WHEN k = 1 THEN oee END) AS cur, avg(CASE WHEN k BETWEEN 2 AND 8 THEN oee END) AS pri,
        count(*) AS m FROM n),
      e AS (SELECT coalesce(cur, 0e0) AS cur, coalesce(CASE WHEN m >= 8 THEN pri ELSE cur END, 0e0) AS pri FROM c)
      SELECT cur AS current_oee, {r("pri", 6)} AS prior_week_oee,
        {r("CASE WHEN pri > 0 THEN (cur - pri) / pri * 100 ELSE 0e0 END", 4)} AS oee_delta_percent FROM e""",
    "plant_trend": f""", d AS ({_DAILY_PLANT}),
      t AS (SELECT plant_name, oee, production_date FROM d
        QUALIFY row_number() OVER (PARTITION BY plant_name ORDER BY production_date DESC) <= 14),
      u AS (SELECT plant_name, CASE WHEN count(*) >= 2 AND arg_max(oee, production_date) > arg_min(oee, production_date)
        THEN 'up' ELSE 'down' END AS trend FROM t GROUP BY 1),
      c AS (SELECT plant_name, {_FIGURES} {_PLACED} WHERE {_last(7)} GROUP BY 1)
      SELECT c.*, coalesce(trend, 'down') AS trend FROM c LEFT JOIN u USING (plant_name)""",
    "oee_mean_of_ratios": f""", m AS (SELECT asset_id, asset_name, line_name,
        avg(CAST(actual AS DOUBLE) / CAST(nullif(planned, 0) AS DOUBLE)) AS av,
        avg(CAST(produced - scrapped AS DOUBLE) / CAST(nullif(produced, 0) AS DOUBLE)) AS qu,
        avg(CAST(produced AS DOUBLE) / CAST(nullif(actual, 0) * 100 AS DOUBLE)) AS pe
        {_PLACED} WHERE {_last(7)} GROUP BY 1, 2, 3),
      o AS (SELECT asset_id, asset_name, line_name, {r("av", 6)} AS availability, {r("qu", 6)} AS quality_rate,
        {r("pe", 6)} AS performance_rate, {r("av * qu * pe * 100", 4)} AS oee_percent FROM m)
      SELECT *, CASE WHEN oee_percent >= 85 THEN 'green' WHEN oee_percent >= 65 THEN 'yellow' ELSE 'red' END AS oee_status
      FROM o ORDER BY availability DESC, asset_id LIMIT 10""",
    "scrap_rate": f"""SELECT asset_id, {r(div(_S, _U), 8)} AS scrap_rate FROM production GROUP BY 1
      ORDER BY scrap_rate DESC, asset_id LIMIT 10""",
    "runtime_by_plant": f"""SELECT plant_name, {r(div(_P, "count(*)"), 4)} AS mean_planned_hours,
      {r(div(_A, "count(*)"), 4)} AS mean_actual_hours {_PLACED} GROUP BY 1""",
    "availability_by_line": f""", x AS (SELECT plant_name, line_name, {r(div(_A, _P), 6)} AS availability {_PLACED} GROUP BY 1, 2)
      SELECT *, row_number() OVER (ORDER BY availability DESC, line_name) AS rank_no FROM x""",
    "uptime_by_process": f"""SELECT process_name, {r(div(_A, _P), 6)} AS uptime {_PLACED} WHERE plant_name = 'ASIA' GROUP BY 1""",
    "units_by_line": f"SELECT line_name, CAST({_U} AS BIGINT) AS units_produced {_PLACED} WHERE {_last(30)} GROUP BY 1",
    "units_per_hour_by_process_type": f"SELECT process_type, {r(div(_U, _A), 4)} AS units_per_hour {_PLACED} GROUP BY 1",
    "weekly_production": f""", x AS (SELECT CAST(date_trunc('week', production_date) AS DATE) AS week_start,
        CAST({_U} AS BIGINT) AS units_produced {_PLACED} WHERE plant_name = 'EUROPE' GROUP BY 1),
      y AS (SELECT x.*, b.units_produced AS p FROM x LEFT JOIN x b ON b.week_start = x.week_start - 7)
      SELECT week_start, units_produced, CASE WHEN p <> 0 THEN
        {r("(CAST(units_produced AS DOUBLE) - p) / p", 6)} END AS change FROM y""",
    "line_revenue": f"""SELECT line_name, CAST(hourly_revenue AS DOUBLE) AS hourly_revenue,
      {r(f"CAST({_A} AS DOUBLE) * CAST(hourly_revenue AS DOUBLE)", 2)} AS revenue {_PLACED} GROUP BY line_name, hourly_revenue""",
}

SQL["oee_by_plant_python"] = SQL["oee_by_plant"]
SQL["health_band_python"] = """SELECT asset_id, CASE WHEN latest_health_score >= 90 THEN 'excellent'
  WHEN latest_health_score >= 75 THEN 'attention' ELSE 'immediate' END AS health_band FROM latest"""
