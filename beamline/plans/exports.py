"""Results written to a sink and read back."""

from __future__ import annotations

from ..operators import quantity as q
from ..registry import query
from ..sources import files
from ..sources.scratch import scratch_path
from ..sources.tables import predictions, table
from .takeoff import _COUNTED_SQL


_EXPORT = f"WITH {_COUNTED_SQL} SELECT section, quantity, confidence, CAST(row_number() OVER (ORDER BY quantity DESC, section) AS INTEGER) AS line FROM quantities WHERE quantity > 0"


@query("export_json_lines", _EXPORT)
def export_json_lines(spark, sf_dir):
    rows, path = q.export_rows(q.quantities(predictions(spark, sf_dir))), scratch_path(spark, "export")
    files.write_json_lines(rows, path)
    return files.read_json_lines(rows, path)


@query("export_csv", _EXPORT)
def export_csv(spark, sf_dir):
    rows, path = q.export_rows(q.quantities(predictions(spark, sf_dir))), scratch_path(spark, "export")
    files.write_csv(rows, path)
    return files.read_csv(rows, path)


@query("partitioned_events", "SELECT event_id, user_id, value, event_type FROM events WHERE event_type = 'error'")
def partitioned_events(spark, sf_dir):
    path = scratch_path(spark, "events")
    files.write_partitioned(table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type"), path, "event_type")
    return spark.read.parquet(path).filter("event_type = 'error'")
