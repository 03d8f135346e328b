"""Named queries: functions from a Warehouse and typed parameters to a DataFrame."""
