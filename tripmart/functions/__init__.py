"""Column-level functions (scalars and projection helpers)."""

from tripmart.functions.columns import across, as_col, is_string, move_after, relabel, rename, replace_column
from tripmart.functions.text import (
    blank_to_null,
    bounded_text,
    is_missing,
    replace_text,
    squish_spaces,
    strip_whitespace,
    title_case,
    trim_spaces,
)
from tripmart.functions.time import (
    day_name,
    day_rank_monday_first,
    day_rank_sunday_first,
    hour_label,
    hour_rank,
    minutes_between,
    minutes_fractional,
    month_name,
    month_number,
    parse_mdy_hm,
    parse_timestamp,
    weekday_number,
)

__all__ = [
    "across", "as_col", "is_string", "move_after", "relabel", "rename", "replace_column",
    "blank_to_null", "bounded_text", "is_missing", "replace_text", "squish_spaces",
    "strip_whitespace", "title_case", "trim_spaces",
    "day_name", "day_rank_monday_first", "day_rank_sunday_first", "hour_label", "hour_rank",
    "minutes_between", "minutes_fractional", "month_name", "month_number", "parse_mdy_hm", "parse_timestamp", "weekday_number",
]
