"""All queries: name -> (callable of (spark, sf_dir), SQL for DuckDB or an empty text)."""

from . import dashboards, layout, more, offers, records, reports, storage, streams  # noqa: F401  (each adds its queries)

QUERIES = dict(dashboards.QUERIES)
