"""Numbers in published tables: decimal commas, spaced thousands, sentinels.

Lenient readers give NULL for anything that is not a number, strict readers raise. Both take
plain, decimal and exponent notation and ``_`` between digits; integers round half away from
zero. Spark-only spellings such as ``12d``, the words ``inf`` and ``nan``, and odd spellings such
as ``+-5`` or ``1e5_2`` are not numbers here.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rankmill.functions.text import trim_spaces

NBSP = "\u00a0"

NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"
BLANKS = "\t\n\v\f\r "


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half(c: Column | str, digits: int) -> Column:
    """A double rounded half away from zero, as SQL engines that work on binary numbers do.

    Multiplied first: a value like 0.44999999999999996, all that binary numbers have of 0.45, is a half after that.
    Spark's own rounding takes the shortest decimal notation and rounds it down.
    """
    scale = F.lit(float(10**digits))
    return F.round(_col(c) * scale, 0) / scale


def lenient_double(c: Column | str) -> Column:
    text = F.btrim(_col(c), F.lit(BLANKS))
    return F.when(text.rlike(NUMBER), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def lenient_int(c: Column | str, to: str = "int") -> Column:
    """Whole number of type ``to``; ``12.5`` gives 13. Plain digits take the cheap first branch."""
    text = F.btrim(_col(c), F.lit(BLANKS))
    exact = F.replace(text, F.lit("_"), F.lit("")).try_cast("decimal(38,10)")
    return F.coalesce(
        _col(c).try_cast(to),
        F.when(text.rlike(NUMBER), F.round(exact, 0).try_cast(to)),
    )


def comma_to_point(c: Column | str) -> Column:
    return F.replace(_col(c), F.lit(","), F.lit("."))


def drop_spaces(c: Column | str, nbsp: bool = True) -> Column:
    """Remove thousands separators: spaces and, unless told otherwise, no-break spaces."""
    return F.translate(_col(c), " " + (NBSP if nbsp else ""), "")


def share_value(c: Column | str) -> Column:
    """Share such as ``97,5``; anything else is NULL."""
    return lenient_double(comma_to_point(c))


def count_value(c: Column | str, to: str = "int", nbsp: bool = True) -> Column:
    """Count such as ``3 877``; anything else is NULL."""
    return lenient_int(drop_spaces(c, nbsp), to)


def marked_share(c: Column | str) -> Column:
    """Share that may carry ``~`` (rounded) or be ``..`` (withheld)."""
    return lenient_double(F.nullif(comma_to_point(F.translate(_col(c), "~", "")), F.lit("..")))


def marked_count(c: Column | str, to: str = "int", nbsp: bool = True) -> Column:
    """Count that may be ``..`` (withheld)."""
    return lenient_int(F.nullif(drop_spaces(c, nbsp), F.lit("..")), to)


def _or_raise(value: Column, source: Column, to: str) -> Column:
    message = F.concat(F.lit("not a number: "), source)
    return F.when(value.isNull() & source.isNotNull(), F.raise_error(message).cast(to)).otherwise(value)


def strict_share(c: Column | str) -> Column:
    """``~100`` is 100; ``..``, ``.`` and empty are withheld; other text is an error."""
    c = _col(c)
    return (
        F.when(c == "~100", F.lit(100.0))
        .when(c.isin("..", ".", ""), F.lit(None).cast("double"))
        .otherwise(_or_raise(lenient_double(comma_to_point(c)), c, "double"))
    )


def strict_count(c: Column | str, to: str = "int") -> Column:
    """Count with spaces or no-break spaces; ``..``, ``.`` and empty are withheld."""
    c = _col(c)
    return (
        F.when(trim_spaces(c).isin("..", ".", ""), F.lit(None).cast(to))
        .otherwise(_or_raise(lenient_int(drop_spaces(c), to), c, to))
    )
