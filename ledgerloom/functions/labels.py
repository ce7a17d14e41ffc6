"""Column functions that read labelled values: sizes named in words, and the venue of a document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.shapes import bare_unit, to_metres
from ledgerloom.functions.text import strip, title_case

# --- fixed values: label words -----------------------------------------------------------------------------------------
SIZE_LABELS = (("depth_m", "depth|deep"), ("height_m", "height|high|ht"), ("length_m", "length|long|width|wide"))
VENUE_LABEL = r"(?i)(?:venue|location|event\s*venue|site)\s*[:\-]\s*(.+)"
VENUE_CELL = r"(?i)^(venue|location|event\s*venue|site)$"
NO_VENUE = "Venue Unspecified"
# ------------------------------------------------------------------------------------------------------------------------


def labelled_dimensions(text: Column) -> Column:
    """struct of depth_m, height_m, length_m: the first value each label is given, null where a label isn't there."""

    def first(words: str) -> Column:
        pattern = rf"(?i)\b(?:{words})\b\s*[:=]?\s*(\d+(?:[.,]\d+)?)\s*(mm|cm|m)?\b"
        value = F.replace(F.regexp_extract(text, pattern, 1), F.lit(","), F.lit(".")).try_cast("double")
        unit = F.lower(F.regexp_extract(text, pattern, 2))
        return F.round(to_metres(value, F.when(unit != "", unit).otherwise(bare_unit(value))), 3)

    return F.struct(*(first(words).alias(name) for name, words in SIZE_LABELS))


def fill_dimensions(measured: Column, text: Column) -> Column:
    """measured (a struct of the same fields) with its missing and zero fields taken from the labels."""
    named = labelled_dimensions(text)
    return F.struct(*(F.when(F.coalesce(measured[n], F.lit(0.0)) > 0, measured[n]).otherwise(F.coalesce(named[n], F.lit(0.0))).alias(n) for n, _ in SIZE_LABELS))


@dataclass(frozen=True)
class Rung:
    """Where candidates come from, what a good one is, and what it is worth."""

    source: str
    shortest: int
    longest: int
    refused: str  # a pattern no good candidate has
    confidence: str
    titled: str  # 'always', 'capitals' (where all letters are) or 'never'


RUNGS = (
    Rung("cells", 1, 10_000, r"^\d+(\.\d+)?$", "high", "capitals"),
    Rung("labels", 2, 60, r"^\d+$", "high", "capitals"),
    Rung("known", 1, 10_000, r"^$", "medium", "never"),
    Rung("file name", 1, 41, r"^$", "medium", "always"),
    Rung("subtitles", 2, 40, r"\d", "low", "always"),
)


def _venue_candidates(file_name: Column, texts: Column, rows: Column, known: list[str]) -> dict[str, Column]:
    """Source -> array of candidate texts in order."""
    nothing = F.array().cast("array<string>")

    def right_of_label(row: Column) -> Column:
        cells = F.transform(row, lambda c: strip(F.coalesce(c, F.lit(""))))
        at = F.array_position(F.transform(cells, lambda c: c.rlike(VENUE_CELL)), F.lit(True)).cast("int")
        return F.when(at > 0, F.slice(cells, at + 1, F.size(cells))).otherwise(nothing)

    tidy = lambda t: F.regexp_replace(t, r"^[ \-:|]+|[ \-:|]+$", "")
    written = F.lower(F.concat_ws(" ", file_name, F.array_join(texts, " ")))
    after_at = F.regexp_extract(file_name, r"@\s*([A-Za-z][A-Za-z0-9 &'-]{2,40})", 1)
    without_date = strip(F.regexp_replace(F.substring_index(F.regexp_replace(strip(after_at), r"\s*-\s*\d", "\u0001"), "\u0001", 1), r"(?i)\.(pdf|xlsx|xls|docx)$", ""))
    subtitles = F.filter(texts, lambda t: (F.length(strip(t)) <= 80) & t.rlike(r"\S - +\S"))
    return {
        "cells": F.flatten(F.transform(rows, right_of_label)),
        "labels": F.transform(texts, lambda t: tidy(F.get(F.split(strip(F.regexp_extract(t, VENUE_LABEL, 1)), r"\s{2,}|\t"), F.lit(0)))),
        "known": F.filter(F.array(*map(F.lit, known)) if known else nothing, lambda v: F.contains(written, F.lower(v))),
        "file name": F.array(without_date),
        "subtitles": F.transform(subtitles, lambda t: strip(F.regexp_extract(strip(t), r"(?: - +)(?!.* - )(.+)$", 1))),
    }


def document_venue(file_name: Column, header_texts: Column, header_rows: Column, known: list[str], rungs: tuple[Rung, ...] = RUNGS) -> Column:
    """struct(venue, confidence) of a document: the first good candidate of the first rung that has one; none without any.

    header_texts is an array of texts, header_rows an array of arrays of cells. By the standard rungs: a labelled cell, a
    labelled text, a known venue's name in the list's order, what follows @ in the file name, the end of a subtitle."""
    texts = F.filter(F.coalesce(header_texts, F.array().cast("array<string>")), lambda t: t.isNotNull())
    rows = F.coalesce(header_rows, F.array().cast("array<array<string>>"))
    found = _venue_candidates(F.coalesce(file_name, F.lit("")), texts, rows, known)
    out = F.when(F.lit(False), F.struct(F.lit("").alias("venue"), F.lit("").alias("confidence")))
    for r in rungs:
        good = F.get(F.filter(found[r.source], lambda v: F.length(v).between(r.shortest, r.longest) & ~v.rlike(r.refused)), F.lit(0))
        shown = {"always": title_case(good), "capitals": F.when(good == F.upper(good), title_case(good)).otherwise(good), "never": good}[r.titled]
        out = out.when(good.isNotNull(), F.struct(shown.alias("venue"), F.lit(r.confidence).alias("confidence")))
    return out.otherwise(F.struct(F.lit(NO_VENUE).alias("venue"), F.lit("none").alias("confidence")))
