"""Raw lines: counts per file, preamble removal, fixed-position parsing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field as default

from pyspark.sql import DataFrame, functions as F

from rankmill.functions.text import field, first_url, like_any, trimmed_field, year_in_name


def count_by_file(lines: DataFrame, name_patterns: Sequence[str] = ()) -> DataFrame:
    """Lines per file, most first; only files whose lower-cased name matches any pattern, if given."""
    if name_patterns:
        lines = lines.filter(like_any(F.lower("source_file"), name_patterns))
    return (
        lines.groupBy("source_file")
        .agg(F.count(F.lit(1)).alias("n_lines"))
        .orderBy(F.col("n_lines").desc(), "source_file")
    )


def drop_boilerplate(lines: DataFrame, patterns: Sequence[str], sep: str = ";") -> DataFrame:
    """Keep lines that hold the separator and match none of the preamble and header patterns."""
    return lines.filter(F.col("raw_line").contains(sep) & ~like_any("raw_line", patterns))


def with_url(lines: DataFrame) -> DataFrame:
    """(statistik_text, url_value, source_file): the line and the first address in it."""
    return lines.filter(F.col("raw_line").isNotNull()).select(
        F.col("raw_line").alias("statistik_text"), first_url("raw_line").alias("url_value"), "source_file"
    )


@dataclass(frozen=True)
class LineFamily:
    """Files with one layout: which files, which lines are not data, which field is which column.

    ``year`` names the column for the year in the file name; ``domain`` limits a column to values.
    """

    columns: Sequence[str]
    boilerplate: Sequence[str] = ()
    prefix: str | None = None
    file: str | None = None
    year: str | None = None
    domain: Mapping[str, Sequence[str]] = default(default_factory=dict)
    trimmed: bool = False
    sep: str = ";"

    def lines(self, raw: DataFrame) -> DataFrame:
        if self.prefix is not None:
            raw = raw.filter(F.col("source_file").startswith(self.prefix))
        if self.file is not None:
            raw = raw.filter(F.col("source_file") == self.file)
        return drop_boilerplate(raw, self.boilerplate, self.sep)

    def parse(self, raw: DataFrame) -> DataFrame:
        """All columns as text; a missing field is NULL, or empty for a trimmed family."""
        cut = trimmed_field if self.trimmed else field
        fields = [cut("raw_line", i + 1, self.sep).alias(c) for i, c in enumerate(self.columns)]
        year = [year_in_name("source_file").alias(self.year)] if self.year else []
        out = self.lines(raw).select(*year, *fields, "source_file")
        for column, values in self.domain.items():
            out = out.filter(F.col(column).isin(list(values)))
        return out
