from . import queries, report_queries  # noqa: F401
