from gapgauge.streaming.dedup import dedup_stream, late_rows, unique_rows
from gapgauge.streaming.ingest import ingest_stream

__all__ = ["dedup_stream", "ingest_stream", "late_rows", "unique_rows"]
