from gapgauge.sources.boards import load_contact_board, load_expected_board, one_per_entity, project_board, read_board, replace_snapshot
from gapgauge.sources.calendar import pending_days, season_calendar
from gapgauge.sources.events import append_days, normalize_event_date, read_events, stringify_exotic
from gapgauge.sources.landing import read_landing_day
from gapgauge.sources.ledger import ingested_days, ledger_entries, ledger_extent, read_ledger, record_days

__all__ = [
    "append_days",
    "ingested_days",
    "ledger_entries",
    "ledger_extent",
    "load_contact_board",
    "load_expected_board",
    "normalize_event_date",
    "one_per_entity",
    "pending_days",
    "project_board",
    "read_board",
    "read_events",
    "read_landing_day",
    "read_ledger",
    "record_days",
    "replace_snapshot",
    "season_calendar",
    "stringify_exotic",
]
