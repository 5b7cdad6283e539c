"""Names and small text formats as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as true, and file names that some systems reserve.
TRUE_WORDS = ("true", "1", "yes", "visible", "show")
RESERVED = ("con", "prn", "aux", "nul", "com1", "com2", "com3", "com4", "com5", "com6", "com7", "com8", "com9", "lpt1", "lpt2", "lpt3", "lpt4", "lpt5", "lpt6", "lpt7", "lpt8", "lpt9")


def truth(value: Column) -> Column:
    return F.lower(F.trim(value)).isin(*TRUE_WORDS)


def file_stem(raw: Column, fallback: str = "untitled") -> Column:
    """Letters, digits, - _ ( ) and spaces stay; a reserved or empty name gets an underscore or the fallback."""
    kept = F.trim(F.regexp_replace(raw, r"[^A-Za-z0-9_() -]", "_"))
    return F.when(kept == "", fallback).when(F.lower(kept).isin(*RESERVED), F.concat(kept, F.lit("_"))).otherwise(kept)


def copy_name(name: Column, mark: bool = True) -> Column:
    return F.concat(name, F.lit(" copy")) if mark else name


def frame_name(label: Column, delay_ms: Column) -> Column:
    return F.concat(F.lit("_a_"), label, F.lit(","), delay_ms.cast("string"))


def frame_label(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^_a_(.*),\d+$", 1), F.lit(""))


def frame_delay(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^_a_.*,(\d{1,9})$", 1), F.lit("")).cast("int")


def keywords(line: Column) -> Column:
    """Parts between commas or semicolons, trimmed, empty ones left out."""
    return F.filter(F.transform(F.split(line, "[,;]"), lambda k: F.trim(k)), lambda k: k != "")


def keyword_line(words: Column) -> Column:
    return F.array_join(words, ", ")
