"""Text column functions. All are built-in Spark expressions (JVM-side,
whole-stage codegen); none is a Python UDF."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tripmart.functions.columns import as_col

# --- fixed values -----------------------------------------------------------------
# Unicode White_Space, as code-point ranges: TAB..CR, SPACE, NEL, NO-BREAK SPACE,
# OGHAM SPACE MARK, EN QUAD..HAIR SPACE, LINE and PARAGRAPH SEPARATOR, NARROW
# NO-BREAK SPACE, MEDIUM MATHEMATICAL SPACE, IDEOGRAPHIC SPACE.
WHITE_SPACE_RANGES = [
    (0x0009, 0x000D), (0x0020, 0x0020), (0x0085, 0x0085), (0x00A0, 0x00A0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
# ------------------------------------------------------------------------------------
WHITE_SPACE = "".join(chr(c) for lo, hi in WHITE_SPACE_RANGES for c in range(lo, hi + 1))
# the same set as a regex class (control whitespace, NEL, every separator Z)
_WS = r"[\t\n\x0B\f\r\x85\p{Z}]"


def trim_spaces(c) -> Column:
    """Trim leading/trailing space characters only (SQL ``TRIM``)."""
    return F.trim(as_col(c))


def strip_whitespace(c) -> Column:
    """Trim leading/trailing whitespace of any kind (tabs, newlines, NBSP, ...):
    a character-set trim, no regular expression per value."""
    return F.btrim(as_col(c), F.lit(WHITE_SPACE))


def strip_whitespace_regex(c) -> Column:
    """The same trim written as a regular expression (reference form)."""
    return F.regexp_replace(as_col(c), rf"^{_WS}+|{_WS}+$", "")


def squish_spaces(c) -> Column:
    """Collapse each run of inner spaces to one space."""
    return F.regexp_replace(as_col(c), " {2,}", " ")


# A word, or what stands between two words. An apostrophe or a dot between two
# letters stays inside the word.
_IN_WORD = r"[\p{L}\p{M}\p{N}_]"
TITLE_PARTS = rf"{_IN_WORD}+(?:(?<=[\p{{L}}\p{{M}}])['’.](?=\p{{L}}){_IN_WORD}+)*|[^\p{{L}}\p{{M}}\p{{N}}_]+"


def title_case(c) -> Column:
    """Lower-case the text, then upper-case the first letter of each word; a
    word is a run of letters, marks, digits and underscores, and of apostrophes and dots
    between letters (``classic_bike`` -> ``Classic_bike``, ``(temp)`` -> ``(Temp)``,
    ``o'hare d.c.`` -> ``O'hare D.c.``)."""
    parts = F.regexp_extract_all(F.lower(as_col(c)), F.lit(TITLE_PARTS), F.lit(0))
    return F.array_join(F.transform(parts, F.initcap), "")


def replace_text(c, fixes: Mapping[str, str]) -> Column:
    """Literal (not regex) replacement of every key of ``fixes`` by its value."""
    out = as_col(c)
    for old, new in fixes.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def blank_to_null(c) -> Column:
    """Empty string -> NULL; anything else unchanged."""
    return F.nullif(as_col(c), F.lit(""))


def is_missing(c, is_text: bool = True) -> Column:
    """NULL, or (for text) the empty string. Never NULL itself."""
    c = as_col(c)
    if is_text:
        return c.isNull() | (c == F.lit(""))
    return c.isNull()


def bounded_text(c, width: int) -> Column:
    """Keep at most ``width`` characters (a ``VARCHAR(width)`` store)."""
    return F.substring(as_col(c), 1, width)
