"""What a table cell says: emptiness, numbers in any locale, units, equality.

Cells are strings, as they were written in JSON or a spreadsheet; a null and a blank cell are both empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that decide what counts as a number, a unit, a flag or a judge's yes.
NUMBER = r"^[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|(?i:inf|infinity|nan))$"
VALUE_AND_UNIT = r"^\s*([+-]?\d*\.?\d+(?:[eE][+-]?\d+)?)\s*([^\d\s].*)?$"
TRUE_FLAGS = ("true", "1", "yes", "y")
AGREEMENT = "YES|SAME"
CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
NUMERIC_TOLERANCE = 1e-9

#: White space of any script, and the four separators.
_SPACE = "".join(map(chr, (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stripped(c: Column | str) -> Column:
    """Without white space (of any script) at the ends; only the ends are looked at, as cells are stripped many times."""
    return F.btrim(_col(c), F.lit(_SPACE))


def is_empty(c: Column | str, kind: T.DataType | None = None) -> Column:
    """Null, NaN, blank, or an array or map without entries."""
    c = _col(c)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNull() | (F.size(c) == 0)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.isNull() | F.isnan(c)
    if kind is None or isinstance(kind, T.StringType):
        return c.isNull() | (stripped(c) == "")
    return c.isNull()


def text_or_nothing(c: Column | str) -> Column:
    """The cell's text; an empty cell is an empty string."""
    return F.when(is_empty(c), F.lit("")).otherwise(_col(c))


def _plain_number(t: Column) -> Column:
    return F.when(t.rlike(NUMBER), F.replace(t, F.lit("_"), F.lit("")).try_cast("double"))


def number(c: Column | str, bare: bool = False) -> Column:
    """A double, with a point or a comma as its decimal mark, or null.

    Spaces inside are left out. A lone kind of mark that plain reading rejects is a decimal comma; where both marks
    stand, the later one is the decimal mark and the other one groups digits. As plain reading knows no comma, the marks
    decide at once which of these a cell is, and it is read once. bare: c is stripped already.
    """
    c = _col(c)
    comma, point = F.instr(F.reverse(c), ","), F.instr(F.reverse(c), ".")
    without = lambda mark: F.replace(c, F.lit(mark), F.lit(""))
    with_point = lambda x: F.replace(x, F.lit(","), F.lit("."))
    marked = F.when(~F.contains(c, F.lit(",")), c).when(~F.contains(c, F.lit(".")), with_point(c)).when(comma < point, with_point(without("."))).otherwise(without(","))
    return _plain_number(F.replace(marked if bare else stripped(marked), F.lit(" "), F.lit("")))


def value_and_unit(c: Column | str) -> Column:
    """struct<value double, unit string> of a number and what follows it; both null where there is no such form."""
    c = _col(c)
    value = F.regexp_extract(c, VALUE_AND_UNIT, 1).try_cast("double")
    unit = stripped(F.regexp_extract(c, VALUE_AND_UNIT, 2))
    fits = c.rlike(VALUE_AND_UNIT)
    return F.struct(F.when(fits, value).alias("value"), F.when(fits & (unit != ""), unit).alias("unit"))


def numeric_equality(a: Column | str, b: Column | str) -> Column:
    """1 for castable values within the tolerance, 0 for others, null where either cannot be cast."""
    x, y = _col(a).try_cast("double"), _col(b).try_cast("double")
    return F.when(x.isNull() | y.isNull(), F.lit(None).cast("double")).when(F.abs(x - y) <= NUMERIC_TOLERANCE, 1.0).otherwise(0.0)


def clean_equality(a: Column | str, b: Column | str, bare: bool = False) -> Column:
    """1 for texts that are equal but for case and white space at the ends and not blank, else 0. bare: both are stripped."""
    x, y = (F.lower(_col(c) if bare else stripped(c)) for c in (a, b))
    return F.when((x == y) & (x != ""), 1.0).otherwise(0.0)


def equality_ratio(a: Column | str, b: Column | str, text_similarity: Column) -> Column:
    """1 for two empty cells; plain numbers are equal or not; others have the similarity of their texts."""
    x, y = _plain_number(stripped(a)), _plain_number(stripped(b))
    return F.when(is_empty(a) & is_empty(b), 1.0).when(x.isNotNull() & y.isNotNull(), F.when(x == y, 1.0).otherwise(0.0)).otherwise(text_similarity)


def flag(c: Column | str) -> Column:
    return F.coalesce(F.lower(stripped(c)).isin(*TRUE_FLAGS), F.lit(False))


def judged(answer: Column | str) -> Column:
    """A judge's answer as a score; no answer stays null."""
    answer = _col(answer)
    return F.when(answer.isNotNull(), F.when(F.upper(answer).rlike(AGREEMENT), 1.0).otherwise(0.0))


def without_controls(c: Column | str) -> Column:
    """Control characters that a workbook cannot hold become spaces; tab, line feed and carriage return stay."""
    return F.regexp_replace(_col(c), CONTROLS, " ")
