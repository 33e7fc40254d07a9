"""Column functions on dates, eras and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the corpus.
ERA = 543
MONTHS = (
    "มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน",
    "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม",
)
SHORT_MONTHS = ("ม.ค.", "ก.พ.", "มี.ค.", "เม.ย.", "พ.ค.", "มิ.ย.", "ก.ค.", "ส.ค.", "ก.ย.", "ต.ค.", "พ.ย.", "ธ.ค.")
DASH = "—"


def _parts(c: Column) -> tuple[Column, Column, Column, Column]:
    y, m, d = (F.regexp_extract(c, r"^(\d{4})-(\d{2})-(\d{2})", i).try_cast("int") for i in (1, 2, 3))
    return y, m, d, F.coalesce(m.between(1, 12) & d.between(1, 31), F.lit(False))


def era_year(year: Column) -> Column:
    return year.cast("int") + ERA


def era_month(month: Column) -> Column:
    """``2026-09`` with the era's year; anything else stays."""
    own = F.concat((F.substring(month, 1, 4).try_cast("int") + ERA).cast("string"), F.substring(month, 5, 3))
    return F.when(month.rlike(r"^\d{4}-\d{2}$"), own).otherwise(month)


def era_range(first: Column, last: Column) -> Column:
    a, b = era_year(first).cast("string"), era_year(last).cast("string")
    return F.when(a.isNull() | b.isNull(), DASH).when(a == b, a).otherwise(F.concat(a, F.lit("–"), b))


def era_date(c: Column, short: bool = False) -> Column:
    """Day, month name and era year; a dash where there is no such date."""
    y, m, d, ok = _parts(c)
    name = F.get(F.array(*[F.lit(x) for x in (SHORT_MONTHS if short else MONTHS)]), m - 1)
    return F.when(ok, F.concat_ws(" ", d.cast("string"), name, (y + ERA).cast("string"))).otherwise(DASH)


def percent(part: Column, whole: Column, digits: int = 0) -> Column:
    """A share as text; between 99 and 100 with a decimal, a dash without a denominator."""
    p = 100 * part / F.nullif(whole, F.lit(0))
    text = lambda k: F.format_string(f"%.{k}f%%", p)
    return F.when(p.isNull(), DASH).when((p > 99) & (p < 100), text(max(1, digits))).otherwise(text(digits))


def change(now: Column, then: Column) -> Column:
    """Change in whole percent, halves up; null without a base."""
    return F.when(then != 0, F.floor(100 * (now - then) / then + 0.5)).cast("long")


def stale(built: Column, today: Column, days: int = 3) -> Column:
    return F.datediff(today, built) >= days


def citation(style: str, title: Column, volume: Column, part: Column, page: Column, date: Column) -> Column:
    """A record cited in one of four styles: standard, footnote, apa, coords. The layouts are fixed values."""
    from facetra.functions import text as tx

    where, when = tx.coordinates(volume, part, page), era_date(date)
    gazette = F.lit(tx.GAZETTE)
    if style == "coords":
        return where
    if style == "standard":
        return F.concat(title, F.lit(", "), gazette, F.lit(" "), where, F.lit(" ("), when, F.lit(")."))
    if style == "footnote":
        return F.concat(title, F.lit(". "), gazette, F.lit(" "), tx.thai_digits(where), F.lit(" ("), tx.thai_digits(when), F.lit(")."))
    if style == "apa":
        y, _, _, ok = _parts(date)
        dated = F.when(ok, F.concat(F.lit("("), (y + ERA).cast("string"), F.lit(", "), F.regexp_replace(when, r"\s\d+$", ""), F.lit(")"))).otherwise(F.lit("(ม.ป.ป.)"))
        vol = F.coalesce(F.when(volume != 0, volume.cast("string")), F.lit(""))
        issue = F.coalesce(F.when(part != "", F.concat(F.lit("("), tx.part_label(part), F.lit(")"))), F.lit(""))
        at = F.coalesce(F.when(page != 0, F.concat(F.lit(", "), page.cast("string"))), F.lit(""))
        return F.concat(title, F.lit(". "), dated, F.lit(". "), gazette, F.lit(", "), vol, issue, at, F.lit("."))
    raise ValueError(f"unknown style {style!r}")
