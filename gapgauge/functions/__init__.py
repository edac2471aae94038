from gapgauge.functions.columns import (
    display_name,
    null_if_nan,
    numeric,
    numeric_columns,
    season_bounds,
    unit_draw,
)

__all__ = ["display_name", "null_if_nan", "numeric", "numeric_columns", "season_bounds", "unit_draw"]
