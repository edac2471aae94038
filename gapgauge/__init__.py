"""gapgauge: observed-versus-expected performance analytics on Spark.

Every public function takes and returns DataFrames; nothing is collected on
the driver except tables whose size is bounded by the calendar, the number of
columns or the number of kinds.
"""

from gapgauge.params import BATTER, PITCHER, KindParams, SignalParams, StudyParams
from gapgauge.session import build_session, cut_lineage

__all__ = [
    "BATTER",
    "PITCHER",
    "KindParams",
    "SignalParams",
    "StudyParams",
    "build_session",
    "cut_lineage",
]
