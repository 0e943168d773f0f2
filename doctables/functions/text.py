"""Column expressions on text: stripping, line classes, CSV and Markdown lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doctables.functions.fixed_values import ENTITY, NAMED_ENTITIES, OUTER_BLANK, SEPARATOR_RUN, TABLE_SEPARATOR, WIDE_BLANK


def strip_blank(text: Column) -> Column:
    """Drop leading and trailing Unicode blanks (``trim`` would only drop U+0020)."""
    return F.regexp_replace(text, OUTER_BLANK, "")


def split_wide_blanks(text: Column) -> Column:
    """Cells of a line: stripped, then cut at every run of two or more blanks."""
    return F.split(strip_blank(text), WIDE_BLANK)


def line_class(line: Column) -> Column:
    """S = table separator, P = line with a pipe, O = anything else."""
    return (
        F.when(line.rlike(TABLE_SEPARATOR), "S").when(line.contains("|"), "P").otherwise("O")
    )


def pipe_row(line: Column) -> Column:
    """A table line with each run of ``-`` and ``+`` turned into one pipe, stripped."""
    return strip_blank(F.regexp_replace(line, SEPARATOR_RUN, "|"))


def count_pipes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))


def csv_line(cells: Column) -> Column:
    """One CSV line: quotes only where needed, inner quotes doubled, null as empty.

    A line that is a single empty cell is written as ``""`` so that it stays a row.
    """
    quoted = F.transform(
        cells,
        lambda c: F.when(
            c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        ).otherwise(F.coalesce(c, F.lit(""))),
    )
    line = F.array_join(quoted, ",")
    return F.when((F.size(cells) == 1) & (line == ""), F.lit('""')).otherwise(line)


def markdown_line(cells: Column) -> Column:
    """``| a | b |`` with pipes and line breaks inside cells escaped."""
    escaped = F.transform(
        cells,
        lambda c: F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), "\r?\n", " "),
    )
    return F.concat(F.lit("| "), F.array_join(escaped, " | "), F.lit(" |"))


def _character(entity: Column) -> Column:
    """The character of an entity, given without ``&`` and ``;``. A number that is no character gives U+FFFD."""
    hexadecimal = F.lower(F.substring(entity, 2, 1)) == "x"
    number = F.when(hexadecimal, F.conv(F.substring(entity, 3, 6), 16, 10)).otherwise(F.substring(entity, 2, 7)).cast("bigint")
    usable = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    numeric = F.when(usable, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")).otherwise("\ufffd")
    found = F.when(entity.startswith("#"), numeric)
    for name, character in NAMED_ENTITIES.items():
        found = found.when(entity == name, character)
    return found


def unescape_html(text: Column) -> Column:
    """Numeric entities and the five predefined ones, all found in one pass, so that nothing is decoded twice."""
    between = F.split(text, ENTITY, -1)
    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)), _character)
    joined = F.array_join(F.zip_with(between, found, lambda t, c: F.concat(t, F.coalesce(c, F.lit("")))), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def without_extension(name: Column) -> Column:
    """``a.b.pdf`` -> ``a.b``; dots at the start of a name do not start an extension."""
    return F.regexp_replace(name, r"^(\.*[^.].*)\.[^.]*$", "$1")
