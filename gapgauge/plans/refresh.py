"""Daily refresh from sources to report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from gapgauge import schemas
from gapgauge.operators.signals import build_signals
from gapgauge.params import ReportParams
from gapgauge.plans.ingest import IngestPaths, daily_ingest, snapshot_ingest
from gapgauge.plans.report import build_report, write_report
from gapgauge.sources.boards import read_board
from gapgauge.sources.events import read_events
from gapgauge.sources.paths import exists

BoardReader = Callable[[str], DataFrame | None]


@dataclass(frozen=True)
class Store:
    """Where everything lies below one root folder."""

    root: str

    def at(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    @property
    def ingest(self) -> IngestPaths:
        return IngestPaths(self.at("landing"), self.at("pitches"), self.at("ingest_log"))


def load_signals(spark: SparkSession, store: Store, params: ReportParams = ReportParams()) -> DataFrame | None:
    """Signals of the stored boards; None before the first expected board."""
    if not exists(spark, store.at("expected_stats")):
        return None
    expected = read_board(spark, store.at("expected_stats"), schemas.EXPECTED_STATS)
    contact = None
    if exists(spark, store.at("batted_ball")):
        contact = read_board(spark, store.at("batted_ball"), schemas.BATTED_BALL)
    return build_signals(expected, contact, params.signals)


def refresh(
    spark: SparkSession,
    store: Store,
    read_expected: BoardReader,
    read_contact: BoardReader,
    year: int,
    snapshot: date | None = None,
    params: ReportParams = ReportParams(),
    skip_events: bool = False,
    as_of: date | None = None,
    **ingest_options,
) -> dict[str, dict]:
    """Boards, then events, then the report. Returns what failed on the way.

    A board or day that fails is left out and asked for again next time.
    Without any stored board there is nothing to report, which is an error.
    """
    snapshot = snapshot or date.today()
    failed: dict[str, dict] = {
        "expected_stats": snapshot_ingest(read_expected, store.at("expected_stats"), snapshot, year, "expected"),
        "batted_ball": snapshot_ingest(read_contact, store.at("batted_ball"), snapshot, year, "contact"),
    }
    if not skip_events:
        failed["pitches"] = daily_ingest(spark, store.ingest, year, **ingest_options)
    signals = load_signals(spark, store, params)
    if signals is None:
        raise ValueError("no board was ever stored")
    events = read_events(spark, store.ingest.events) if exists(spark, store.ingest.events) else None
    write_report(build_report(signals, events, year, params, as_of), store.at("report"))
    return failed
