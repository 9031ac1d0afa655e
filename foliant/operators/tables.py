"""Grids as ``ARRAY<ARRAY<STRING>>`` columns: trimming, header test, coordinates, rendering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row; inside lambdas Spark would compute it again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def width(rows: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))


def padded(rows: Column) -> Column:
    return bound(width(rows), lambda n: F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(n - F.size(r), F.lit(0))))))


def trimmed(rows: Column) -> Column:
    """Without empty first and last rows and empty columns; rows of one length."""
    filled = lambda r: F.exists(r, lambda c: T.strip(c) != "")

    def inner(some: Column) -> Column:
        first = F.array_position(some, True)
        last = F.size(some) - F.array_position(F.reverse(some), True) + 1
        return F.when(first == 0, F.slice(rows, 1, 0)).otherwise(F.slice(rows, F.greatest(first, F.lit(1)).cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")))

    def columns(body: Column) -> Column:
        used = lambda k: F.exists(body, lambda r: T.strip(F.coalesce(F.get(r, k), F.lit(""))) != "")
        keep = F.filter(F.sequence(F.lit(0), F.greatest(width(body) - 1, F.lit(0))), used)
        return bound(keep, lambda kept: F.transform(body, lambda r: F.transform(kept, lambda k: F.get(r, k))))

    return bound(bound(F.transform(rows, filled), inner), lambda body: bound(padded(body), columns))


def looks_like_header(rows: Column, bold: Column) -> Column:
    """Whether the first row is a header, by boldness, or by numbers that only later rows have."""
    first, rest = F.get(rows, F.lit(0)), F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    numbers = lambda r: F.exists(r, T.is_numeric_cell)
    others = F.slice(bold, 2, F.greatest(F.size(bold) - 1, F.lit(0)))
    mean = F.aggregate(others, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(others), F.lit(1))
    by_weight = (F.get(bold, F.lit(0)) >= 0.6) & (mean < 0.5)
    filled = F.size(F.filter(first, lambda c: T.strip(c) != ""))
    by_numbers = ~numbers(first) & F.exists(rest, numbers) & (filled >= F.greatest(F.lit(2), F.floor(F.size(first) / 2).cast("int")))
    return (F.size(rows) >= 2) & (F.coalesce(by_weight, F.lit(False)) | by_numbers)


def plausible(rows: Column) -> Column:
    """At least three rows of two columns, three cells in five filled, and all rows but one with several."""
    cells = F.flatten(rows)
    filled = F.size(F.filter(cells, lambda c: T.strip(c) != ""))
    several = F.size(F.filter(rows, lambda r: F.size(F.filter(r, lambda c: T.strip(c) != "")) >= 2))
    return (F.size(rows) >= 3) & (width(rows) >= 2) & (filled >= 0.6 * F.size(cells)) & (several >= F.greatest(F.lit(2), F.size(rows) - 1))


def snapped(points: DataFrame, keys: list[str], value: str, tolerance: float = 3.0) -> DataFrame:
    """Means of runs of ``value`` whose neighbours are no more than ``tolerance`` apart."""
    up = Window.partitionBy(*keys).orderBy(value)
    fresh = F.coalesce((F.col(value) - F.lag(value).over(up) > tolerance).cast("int"), F.lit(0))
    runs = points.withColumn("_new", fresh).withColumn("_run", F.sum("_new").over(up.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "_run").agg(F.avg(value).alias(value)).drop("_run")


def pipe(rows: Column) -> Column:
    """A pipe table; the first row is its header."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    body = F.transform(padded(rows), lambda r: line(F.transform(r, T.escape_cell)))
    rule = line(F.array_repeat(F.lit("---"), width(rows)))
    return F.array_join(F.concat(F.slice(body, 1, 1), F.array(rule), F.slice(body, 2, F.greatest(F.size(body) - 1, F.lit(0)))), "\n")


def html(rows: Column, has_header: Column) -> Column:
    def cell(c: Column) -> Column:
        c = T.strip(c)
        for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
            c = F.replace(c, F.lit(raw), F.lit(safe))
        return c

    row = lambda r, tag: F.array_join(F.transform(r, lambda c: F.concat(F.lit(f"<{tag}>"), cell(c), F.lit(f"</{tag}>"))), "")
    all_rows = padded(rows)
    head = F.when(has_header, F.array(F.concat(F.lit("<thead><tr>"), row(F.get(all_rows, F.lit(0)), "th"), F.lit("</tr></thead>")))).otherwise(F.array().cast("array<string>"))
    rest = F.when(has_header, F.slice(all_rows, 2, F.greatest(F.size(all_rows) - 1, F.lit(0)))).otherwise(all_rows)
    body = F.transform(rest, lambda r: F.concat(F.lit("<tr>"), row(r, "td"), F.lit("</tr>")))
    return F.array_join(F.concat(F.array(F.lit("<table>")), head, F.array(F.lit("<tbody>")), body, F.array(F.lit("</tbody>"), F.lit("</table>"))), "\n")


def csv(rows: Column) -> Column:
    def field(c: Column) -> Column:
        c = T.one_line(c)
        return F.when(c.rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)

    line = lambda r: F.when((F.size(r) == 1) & (T.one_line(F.get(r, F.lit(0))) == ""), '""').otherwise(F.array_join(F.transform(r, field), ","))
    return F.concat(F.lit("```csv\n"), F.array_join(F.transform(padded(rows), line), "\n"), F.lit("\n```"))


def tabs(rows: Column) -> Column:
    return F.array_join(F.transform(padded(rows), lambda r: F.array_join(F.transform(r, T.one_line), "\t")), "\n")


def rendered(rows: Column, has_header: Column, mode: str) -> Column:
    """A grid in one of the table modes; without rows and in mode drop it is empty."""
    if mode == "drop":
        return F.lit("")
    made = {"markdown": lambda: pipe(rows), "html": lambda: html(rows, has_header), "csv": lambda: csv(rows), "text": lambda: tabs(rows)}[mode]()
    return F.when(F.size(rows) > 0, made).otherwise("")
