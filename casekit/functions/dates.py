"""Dates in the two spellings that records come with."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

FORMATS = ("dd-MM-yyyy", "dd/MM/yyyy")


def parse_date(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """The date of a day-first text in the first format that fits, or null."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def year_of(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    return F.year(parse_date(text, formats))


def stamp(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd_HHmmss")
