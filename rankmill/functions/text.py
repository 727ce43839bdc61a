"""Text helpers: fields of a delimited line, codes, categories, years, URLs, file names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Everything str.strip() treats as white space, written out so that any regex engine agrees.
UNICODE_BLANK = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACES = "".join(chr(c) for c in (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000))
CONTROL_BLANKS = "".join(chr(c) for c in (*range(0x09, 0x0E), *range(0x1C, 0x20), 0x85, 0x2028, 0x2029))
URL = r'(https?://[^\s;,")]+)'
YEAR_DIGITS = "([0-9]{4})"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str) -> Column:
    return ~_col(c).rlike(f"[^{UNICODE_BLANK}]")


def strip(c: Column | str) -> Column:
    """Drop white space of any kind from both ends."""
    return F.btrim(_col(c), F.lit(SPACES + CONTROL_BLANKS))


def trim_spaces(c: Column | str) -> Column:
    """Drop space separators (no-break spaces too) but not tabs or line ends from both ends."""
    return F.btrim(_col(c), F.lit(SPACES))


def field(line: Column | str, position: int, sep: str = ";") -> Column:
    """Field at a 1-based position, NULL when the line is too short."""
    return F.get(F.split(_col(line), re.escape(sep)), F.lit(position - 1))


def trimmed_field(line: Column | str, position: int, sep: str = ";") -> Column:
    """Trimmed field at a 1-based position, empty when the line is too short."""
    return trim_spaces(F.split_part(_col(line), F.lit(sep), F.lit(position)))


def year_in_name(name: Column | str) -> Column:
    """First run of four digits as a number."""
    return F.regexp_extract(_col(name), YEAR_DIGITS, 1).try_cast("int")


def normal_year(year: Column | str) -> Column:
    """Keep 1900 to 2100; otherwise take the first four characters (20242025 gives 2024)."""
    year = _col(year)
    return F.when(year.between(1900, 2100), year.cast("int")).otherwise(
        F.substring(year.cast("string"), 1, 4).try_cast("int")
    )


def normal_category(c: Column | str, needles: Mapping[str, str]) -> Column:
    """Label of the first needle contained in the text, case ignored; else the text itself."""
    c = _col(c)
    out = None
    for needle, label in needles.items():
        hit = F.lower(c).contains(needle)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(c)


def pad_code(c: Column | str, width: int) -> Column:
    """Left-pad with zeros to exactly ``width`` (longer codes are cut)."""
    return F.lpad(_col(c).cast("string"), width, "0")


def zero_fill(c: Column | str, width: int) -> Column:
    """Left-pad with zeros to at least ``width`` (longer codes stay); a sign stays in front."""
    text = _col(c).cast("string")
    sign = F.regexp_extract(text, r"^([+-]?)", 1)
    digits = F.substr(text, F.length(sign) + 1)
    return F.when(F.length(text) >= width, text).otherwise(
        F.concat(sign, F.lpad(digits, F.lit(width) - F.length(sign), F.lit("0")))
    )


def only_digits(c: Column | str) -> Column:
    return F.regexp_replace(_col(c).cast("string"), r"\D", "")


def first_url(c: Column | str) -> Column:
    """First http(s) address in the text, NULL when there is none."""
    return F.nullif(F.regexp_extract(_col(c), URL, 1), F.lit(""))


def school_year_start(label: Column | str) -> Column:
    """Leading year of a label such as ``2015/16``; -1 when there is none."""
    return F.coalesce(F.substring(_col(label), 1, 4).try_cast("int"), F.lit(-1))


def like_any(c: Column | str, patterns: Sequence[str]) -> Column:
    """True when the text matches any LIKE pattern."""
    out = F.lit(False)
    for pattern in patterns:
        out = out | _col(c).like(pattern)
    return out


def file_name() -> Column:
    """Name of the file a row was read from. Spark reports it URL-encoded but leaves ``+`` alone."""
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
