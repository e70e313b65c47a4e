"""Year-keyed measure objects as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEAR_OBJECT = "map<string, array<double>>"


def year_date(year: Column) -> Column:
    """First day of the year, null where the text is not a year."""
    return F.to_date(F.try_to_timestamp(year, F.lit("yyyy")))


def year_rows(objects: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``{year: [internet, human]}`` JSON objects to one row per year."""
    entries = objects.select(*keep, F.explode(F.from_json(column, YEAR_OBJECT)).alias("year", "pair"))
    return entries.select(
        *keep, "year", F.get("pair", F.lit(0)).alias("internet"), F.get("pair", F.lit(1)).alias("human")
    )


def year_extent(rows: DataFrame) -> DataFrame:
    """Span of years and the extremes the two axes are scaled to."""
    return rows.agg(
        F.min(year_date(F.col("year"))).alias("first_year"),
        F.max(year_date(F.col("year"))).alias("last_year"),
        F.max("internet").alias("internet_max"),
        F.min("human").alias("human_min"),
        F.max("human").alias("human_max"),
    )


def year_range(
    rows: DataFrame, country: str, year_from: int, year_to: int, metrics: tuple[str, ...]
) -> DataFrame:
    """Chosen measures of one country in a range of years, both ends included."""
    return rows.filter(
        (F.col("country") == F.lit(country))
        & F.col("year").try_cast("int").between(F.lit(year_from), F.lit(year_to))
    ).select("country", "year", *metrics)


def metric_rows(objects: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``{year: {metric: value}}`` JSON objects of any metrics to one row per year and metric.

    Nothing is declared: years and metrics are the keys that the objects have. A year whose value is
    a list instead has its places as metrics; a value that is no number is null. Texts that are no
    JSON, and objects that are empty, give no rows.
    """
    rows = objects.select(*keep, F.try_parse_json(column).alias("_object"))
    years = explode_variant(rows, "_object", keep, "year", "_measures")
    cells = explode_variant(years, "_measures", (*keep, "year"), "metric", "_value")
    value = F.try_variant_get("_value", "$", "double").alias("value")
    return cells.select(*keep, "year", "metric", value)


def explode_variant(rows: DataFrame, column: str, keep: tuple[str, ...], name: str, value: str) -> DataFrame:
    """One row per entry of an object or a list; an entry of a list is named by its place."""
    columns = ", ".join(f"`{c}`" for c in keep)
    return rows.sparkSession.sql(
        f"""SELECT {columns + ", " if keep else ""}coalesce(e.key, CAST(e.pos AS STRING)) AS `{name}`, e.value AS `{value}`
            FROM {{rows}}, LATERAL variant_explode(`{column}`) AS e""",
        rows=rows,
    )


def metric_extent(rows: DataFrame) -> DataFrame:
    """Span of years and extremes of every metric."""
    year = year_date(F.col("year"))
    return rows.groupBy("metric").agg(
        F.min(year).alias("first_year"),
        F.max(year).alias("last_year"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
        F.count("value").alias("values"),
    )
