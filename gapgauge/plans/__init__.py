from gapgauge.plans.ingest import IngestPaths, daily_ingest, ingest_days, rejected_counts, snapshot_ingest
from gapgauge.plans.refresh import Store, load_signals, refresh
from gapgauge.plans.report import build_report, group_summary, report_rows, write_report
from gapgauge.plans.study import study_pairs, validation_study

__all__ = [
    "IngestPaths",
    "Store",
    "build_report",
    "daily_ingest",
    "group_summary",
    "ingest_days",
    "load_signals",
    "refresh",
    "rejected_counts",
    "report_rows",
    "snapshot_ingest",
    "study_pairs",
    "validation_study",
    "write_report",
]
