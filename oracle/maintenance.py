"""Maintenance, parts, technicians, budget, schedule."""

from __future__ import annotations

from oracle.prelude import TELEMETRY_TODAY, TODAY, div, r

_COST = "CAST(sum(parts_cost + labor_cost) AS DOUBLE)"
_PLACED = "FROM maintenance JOIN placed USING (asset_id)"
_BUDGET = """, budget AS (SELECT plant_id, plant_name, year(completed_date) + 1 AS yr, quarter(completed_date) AS quarter,
    CASE WHEN wo_type_id <= 2 THEN 'CapEx Project' ELSE 'OpEx Maintenance' END AS budget_type, sum(parts_cost + labor_cost) AS amount
    FROM maintenance JOIN placed USING (asset_id) GROUP BY ALL)"""
_TECH = "FROM maintenance JOIN technician USING (technician_id)"


def _last(days: int) -> str:
    return f"completed_date BETWEEN {TODAY} - {days} AND {TODAY}"


SQL: dict[str, str] = {
    "maintenance_cost_by_type": f""", x AS (SELECT wo_type_name, {_COST} AS total_cost FROM maintenance JOIN wo_type USING (wo_type_id) GROUP BY 1)
      SELECT *, {r("total_cost / (SELECT sum(total_cost) FROM x)", 6)} AS share FROM x""",
    "maintenance_history": f"""SELECT log_id, asset_name, completed_date, wo_type_name, CAST(downtime_hours AS DOUBLE) AS downtime_hours,
      CAST(parts_cost + labor_cost AS DOUBLE) AS total_cost, left(technician_notes, 100) AS notes, failure_flag
      FROM maintenance JOIN asset USING (asset_id) JOIN wo_type USING (wo_type_id) WHERE {_last(30)} ORDER BY completed_date DESC, log_id LIMIT 20""",
    "maintenance_history_asset": """SELECT log_id, completed_date, CAST(downtime_hours AS DOUBLE) AS downtime_hours,
      CAST(parts_cost AS DOUBLE) AS parts_cost, CAST(labor_cost AS DOUBLE) AS labor_cost, failure_flag, wo_type_name, technician_name,
      h2 || ': ' || h3 AS failure_description, technician_notes FROM maintenance JOIN wo_type USING (wo_type_id)
      LEFT JOIN technician USING (technician_id) LEFT JOIN failure_code USING (failure_code_id)
      WHERE asset_id = 7 AND completed_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'""",
    "maintenance_summary": f"""SELECT asset_id, CAST(sum(downtime_hours) AS DOUBLE) AS total_downtime, {_COST} AS total_cost,
      count(*) FILTER (failure_flag) AS failure_events FROM maintenance WHERE completed_date BETWEEN DATE '2000-01-01' AND DATE '2000-12-31' GROUP BY 1""",
    "maintenance_roi": f""", x AS (SELECT plant_name, CAST(sum(parts_cost + labor_cost) FILTER (wo_type_id <> 1) AS DOUBLE) AS c,
        CAST(sum(parts_cost + labor_cost) FILTER (wo_type_id = 1) AS DOUBLE) AS a,
        sum(parts_cost + labor_cost) FILTER (wo_type_id = 1) - sum(parts_cost + labor_cost) FILTER (wo_type_id <> 1) AS g {_PLACED} GROUP BY 1)
      SELECT plant_name, c AS program_cost, a AS cost_avoidance, {r(div("g", "c"), 6)} AS roi FROM x""",
    "technician_workload": f"SELECT technician_id, technician_name, count(*) AS orders {_TECH} GROUP BY 1, 2",
    "technician_units": f"""SELECT technician_id, technician_name, count(*) AS orders, count(DISTINCT asset_id) AS assets {_TECH}
      WHERE year(completed_date) = 2000 GROUP BY 1, 2""",
    "top_technician": f"""SELECT technician_id, technician_name, count(*) AS orders {_TECH} WHERE year(completed_date) = 2000
      GROUP BY 1, 2 ORDER BY orders DESC, technician_id LIMIT 1""",
    "labor_by_craft": f""", x AS (SELECT craft, {r(div("sum(labor_cost)", "count(*)"), 4)} AS mean_labor_cost {_TECH} GROUP BY 1)
      SELECT *, rank() OVER (ORDER BY mean_labor_cost DESC, craft) AS rank_no FROM x""",
    "activities_by_shift": f"""SELECT shift, count(*) AS orders, count(DISTINCT technician_id) AS technicians,
      {r(div("count(*)", "count(DISTINCT technician_id)"), 4)} AS orders_per_technician {_TECH} GROUP BY 1""",
    "evening_shift_orders": f"SELECT count(*) AS orders {_TECH} WHERE shift = 'Evening' AND {_last(30)}",
    "technician_type_matrix": f"""SELECT technician_id, technician_name, count(*) FILTER (wo_type_id = 1) AS emergency,
      count(*) FILTER (wo_type_id = 2) AS predictive, count(*) FILTER (wo_type_id = 3) AS preventive,
      count(*) FILTER (wo_type_id = 4) AS inspection {_TECH} GROUP BY 1, 2""",
    "prevention_ratio": f""", x AS (SELECT technician_id, technician_name, count(*) FILTER (wo_type_id = 3) AS preventive,
        count(*) FILTER (wo_type_id = 1) AS emergency {_TECH} GROUP BY 1, 2),
      y AS (SELECT *, {r("CAST(preventive AS DOUBLE) / nullif(emergency, 0)", 6)} AS prevention_ratio FROM x)
      SELECT * FROM y ORDER BY prevention_ratio DESC NULLS LAST, technician_id LIMIT 10""",
    "emergency_orders": f"SELECT count(*) AS orders FROM maintenance WHERE wo_type_id = 1 AND {_last(30)}",
    "downtime_by_type": f"""SELECT wo_type_name, {r(div("sum(downtime_hours)", "count(*)"), 4)} AS mean_downtime
      FROM maintenance JOIN wo_type USING (wo_type_id) GROUP BY 1""",
    "planned_unplanned_downtime": f""", x AS (SELECT {div("sum(downtime_hours) FILTER (wo_type_id <> 1)", "count(*) FILTER (wo_type_id <> 1)")} AS p,
        {div("sum(downtime_hours) FILTER (wo_type_id = 1)", "count(*) FILTER (wo_type_id = 1)")} AS u FROM maintenance)
      SELECT {r("p", 4)} AS planned_mean, {r("u", 4)} AS unplanned_mean, {r("u - p", 4)} AS difference FROM x""",
    "planned_unplanned_ratio": f""", x AS (SELECT plant_name, count(*) FILTER (wo_type_id <> 1) AS planned, count(*) FILTER (wo_type_id = 1) AS unplanned
        {_PLACED} GROUP BY 1) SELECT *, {r("CAST(planned AS DOUBLE) / nullif(unplanned, 0)", 6)} AS ratio FROM x""",
    "failures_vs_preventive": """SELECT count(*) FILTER (failure_flag) AS failures, count(*) FILTER (wo_type_id = 3) AS preventive_actions FROM maintenance""",
    "downtime_by_line": f"SELECT line_name, CAST(sum(downtime_hours) AS DOUBLE) AS downtime_hours {_PLACED} WHERE {_last(30)} GROUP BY 1",
    "downtime_in_month": """SELECT CAST(sum(downtime_hours) AS DOUBLE) AS downtime_hours, count(*) AS orders FROM maintenance
      WHERE completed_date BETWEEN DATE '2000-09-01' AND DATE '2000-09-30'""",
    "top_failure_codes": """SELECT failure_code_id, count(*) AS orders, h1 AS failure_hierarchy_1, h2 AS failure_hierarchy_2, h3 AS failure_hierarchy_3
      FROM maintenance JOIN failure_code USING (failure_code_id) WHERE year(completed_date) = 2000 GROUP BY ALL
      ORDER BY orders DESC, failure_code_id LIMIT 5""",
    "failure_hierarchy": """SELECT h1 AS failure_hierarchy_1, h2 AS failure_hierarchy_2, h3 AS failure_hierarchy_3, count(*) AS orders,
      CAST(GROUPING(h1, h2, h3) AS INTEGER) AS level FROM maintenance JOIN failure_code USING (failure_code_id) GROUP BY ROLLUP (h1, h2, h3)""",
    "failure_rate_by_process": f"""SELECT process_name, {r(div("count(*) FILTER (failure_flag)", "count(*)"), 6)} AS failure_rate {_PLACED}
      GROUP BY 1 ORDER BY failure_rate DESC, process_name LIMIT 10""",
    "cost_by_process": f"""SELECT process_name, {_COST} AS total_cost {_PLACED}
      WHERE completed_date BETWEEN DATE '2001-04-01' AND DATE '2001-06-30' GROUP BY 1""",
    "downtime_impact_by_plant": f"SELECT plant_name, CAST(sum(downtime_hours * downtime_impact_per_hour) AS DOUBLE) AS impact {_PLACED} GROUP BY 1",
    "orders_by_asset_class": f"SELECT class_name, count(*) AS orders {_PLACED} GROUP BY 1",
    "emergency_mom": f""", x AS (SELECT CAST(date_trunc('month', completed_date) AS DATE) AS month_start, count(*) AS orders
        FROM maintenance WHERE wo_type_id = 1 GROUP BY 1),
      a AS (SELECT CAST(unnest(generate_series(min(month_start), max(month_start), INTERVAL 1 MONTH)) AS DATE) AS month_start FROM x),
      z AS (SELECT month_start, coalesce(orders, 0) AS orders FROM a LEFT JOIN x USING (month_start)),
      y AS (SELECT z.*, b.orders AS p FROM z LEFT JOIN z b ON b.month_start + INTERVAL 1 MONTH = z.month_start)
      SELECT month_start, orders, CASE WHEN p <> 0 THEN {r("(CAST(orders AS DOUBLE) - p) / p", 6)} END AS change FROM y""",
    "cost_by_quarter": f""", x AS (SELECT year(completed_date) || '-Q' || quarter(completed_date) AS quarter, {_COST} AS total_cost FROM maintenance GROUP BY 1)
      SELECT *, rank() OVER (ORDER BY total_cost DESC, quarter) AS rank_no FROM x""",
    "costliest_quarter": f"""SELECT CAST(quarter(completed_date) AS INTEGER) AS quarter, {_COST} AS total_cost FROM maintenance GROUP BY 1
      ORDER BY total_cost DESC LIMIT 1""",
    "top_parts": """SELECT material_id, count(*) AS uses, CAST(sum(quantity_used) AS DOUBLE) AS quantity, material_nk
      FROM parts JOIN material USING (material_id) GROUP BY material_id, material_nk ORDER BY uses DESC, quantity DESC, material_id LIMIT 10""",
    "parts_cost_by_type": """SELECT wo_type_name, CAST(sum(total_cost) AS DOUBLE) AS parts_cost FROM parts JOIN maintenance USING (log_id)
      JOIN wo_type USING (wo_type_id) WHERE year(completed_date) = 2000 GROUP BY 1""",
    "parts_per_event": f"""SELECT wo_type_name, {r(div("coalesce(sum(q), 0)", "count(*)"), 4)} AS parts_per_order FROM maintenance
      JOIN wo_type USING (wo_type_id) LEFT JOIN (SELECT log_id, sum(quantity_used) AS q FROM parts GROUP BY 1) USING (log_id) GROUP BY 1""",
    "supplier_max_cost": """SELECT supplier_name, CAST(max(unit_cost) AS DOUBLE) AS max_unit_cost FROM material GROUP BY 1
      ORDER BY max_unit_cost DESC, supplier_name LIMIT 1""",
    "spend_on_kind": """SELECT CAST(sum(total_cost) AS DOUBLE) AS total_cost, CAST(sum(quantity_used) AS DOUBLE) AS quantity
      FROM parts JOIN material USING (material_id) WHERE material_nk LIKE 'PROMO-%'""",
    "usage_rate": f"""SELECT material_id, {r('''CAST(sum(quantity_used) AS DOUBLE) * 30e0
        / (SELECT CAST(date_diff('day', min(completed_date), max(completed_date)) + 1 AS DOUBLE) FROM maintenance)''', 6)} AS monthly_usage
      FROM parts GROUP BY 1""",
    "bill_of_parts": """, rules AS (SELECT i // 4 + 1 AS wo_type_id, i % 4 AS slot, i * 3 % 20 + 1 AS material_id, i % 3 + 1 AS quantity
        FROM range(16) t(i)), x AS (SELECT log_id, asset_id, wo_type_id, unnest(range(1, 6 - wo_type_id)) AS part_no FROM maintenance)
      SELECT log_id, CAST(part_no AS INTEGER) AS part_no, material_id, quantity, CAST(quantity * unit_cost AS DOUBLE) AS total_cost
      FROM x JOIN rules ON rules.wo_type_id = x.wo_type_id AND rules.slot = (x.asset_id + x.part_no) % 4 JOIN material USING (material_id)""",
    "budget_total": f"{_BUDGET} SELECT CAST(sum(amount) AS DOUBLE) AS budget_amount FROM budget WHERE budget_type = 'OpEx Maintenance' AND yr = 2000 AND quarter = 3",
    "budget_share": f"""{_BUDGET}, x AS (SELECT plant_name, CAST(sum(amount) AS DOUBLE) AS budget_amount FROM budget
        WHERE yr = 2000 AND budget_type = 'OpEx Maintenance' GROUP BY 1)
      SELECT *, {r("budget_amount / (SELECT CAST(sum(amount) AS DOUBLE) FROM budget WHERE yr = 2000 AND budget_type = 'OpEx Maintenance')", 6)} AS share FROM x""",
    "budget_type_share": f"""{_BUDGET}, x AS (SELECT budget_type, CAST(sum(amount) AS DOUBLE) AS budget_amount FROM budget WHERE yr = 2000 GROUP BY 1)
      SELECT *, {r("budget_amount / (SELECT CAST(sum(amount) AS DOUBLE) FROM budget WHERE yr = 2000)", 6)} AS share FROM x""",
    "budget_yoy": f"""{_BUDGET}, x AS (SELECT plant_name, CAST(yr AS INTEGER) AS year, CAST(sum(amount) AS DOUBLE) AS budget_amount FROM budget
        WHERE budget_type = 'OpEx Maintenance' GROUP BY 1, 2)
      SELECT a.plant_name, a.year, a.budget_amount, b.budget_amount AS previous,
        {r("(a.budget_amount - b.budget_amount) / b.budget_amount", 6)} AS growth
      FROM x a LEFT JOIN x b ON a.plant_name = b.plant_name AND a.year = b.year + 1""",
    "budget_spent": f"""{_BUDGET}, b AS (SELECT plant_name, CAST(sum(amount) AS DOUBLE) AS budget FROM budget WHERE yr = 2001 GROUP BY 1),
      s AS (SELECT plant_name, {_COST} AS spent {_PLACED} WHERE completed_date BETWEEN DATE '2001-01-01' AND {TODAY} GROUP BY 1)
      SELECT plant_name, budget, coalesce(spent, 0e0) AS spent, {r(div("coalesce(spent, 0e0)", "budget"), 6)} AS spent_share FROM b LEFT JOIN s USING (plant_name)""",
    "maintenance_calendar": """, x AS (SELECT asset_id, unnest(range(0, 31)) AS n FROM asset),
      y AS (SELECT *, CASE WHEN n % 30 = asset_id % 30 THEN 3 WHEN n % 15 = asset_id % 15 THEN 4 WHEN n % 20 = (asset_id * 2) % 20 THEN 2 END AS wo_type_id FROM x)
      SELECT asset_id, DATE '2024-02-01' + CAST(n AS INTEGER) AS due_date, wo_type_id, (asset_id + n) % 10 + 1 AS technician_id FROM y WHERE wo_type_id IS NOT NULL""",
    "actual_runtime": """, p AS (SELECT asset_id, production_date AS day, sum(planned) AS planned, sum(scrapped) AS scrapped FROM production GROUP BY 1, 2),
      m AS (SELECT asset_id, completed_date AS day, sum(downtime_hours) AS h, bool_or(failure_flag) AS f FROM maintenance GROUP BY 1, 2)
      SELECT asset_id, day, CAST(planned AS DOUBLE) AS planned_hours, CAST(coalesce(h, 0) AS DOUBLE) AS downtime_hours,
        CAST(greatest(planned - coalesce(h, 0), 0) AS DOUBLE) AS actual_hours, coalesce(f, false) AS had_failure,
        CAST(scrapped AS BIGINT) AS scrapped FROM p LEFT JOIN m USING (asset_id, day)""",
    "scrap_from_failures": """, p AS (SELECT asset_id, production_date AS day, sum(scrapped) AS scrapped FROM production GROUP BY 1, 2)
      SELECT EXISTS (SELECT 1 FROM maintenance m WHERE m.asset_id = p.asset_id AND m.completed_date = p.day AND failure_flag) AS had_failure,
        CAST(sum(scrapped) AS BIGINT) AS units_scrapped, count(*) AS asset_days FROM p GROUP BY 1""",
    "volume_vs_maintenance": f""", u AS (SELECT line_name, year(production_date) || '-Q' || quarter(production_date) AS q, sum(produced) AS units
        FROM production JOIN machine_placed USING (asset_id) GROUP BY 1, 2),
      o AS (SELECT line_name, year(completed_date) || '-Q' || quarter(completed_date) AS q, count(*) AS orders {_PLACED} GROUP BY 1, 2),
      f AS (SELECT line_name, q, coalesce(units, 0) AS units, coalesce(orders, 0) AS orders FROM u FULL JOIN o USING (line_name, q))
      SELECT line_name, CAST(sum(units) AS BIGINT) AS units, CAST(sum(orders) AS BIGINT) AS orders, {r("corr(units, orders)", 4)} AS correlation
      FROM f WHERE EXISTS (SELECT 1 FROM u a WHERE a.line_name = f.line_name AND a.q <= f.q)
        AND EXISTS (SELECT 1 FROM u b WHERE b.line_name = f.line_name AND b.q >= f.q) GROUP BY 1""",
    "overdue_preventive": f""", d AS (SELECT DISTINCT asset_id, completed_date FROM service WHERE wo_type_id = 3),
      x AS (SELECT asset_id, date_diff('day', lag(completed_date) OVER (PARTITION BY asset_id ORDER BY completed_date), completed_date) AS pause FROM d),
      o AS (SELECT asset_id, max(completed_date) AS last FROM d GROUP BY 1),
      y AS (SELECT asset_id, pause FROM x UNION ALL
        SELECT coalesce(a.asset_id, o.asset_id), date_diff('day', coalesce(last, installation_date), {TELEMETRY_TODAY}) FROM asset a FULL JOIN o ON a.asset_id = o.asset_id)
      SELECT asset_id, CAST(max(pause) AS INTEGER) AS longest_pause FROM y GROUP BY 1 HAVING max(pause) > 10""",
    "recent_by_asset": """SELECT asset_id, log_id, completed_date, row_number() OVER (PARTITION BY asset_id ORDER BY completed_date DESC, log_id DESC) AS row_no
      FROM maintenance QUALIFY row_no <= 5""",
}
