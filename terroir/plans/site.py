"""The files a static site reads, written as JSON lines with sorted keys and rounded figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terroir.constants import CERTAIN, REFORM
from terroir.operators import fold
from terroir.plans import marts
from terroir.sources import sinks


def payload(market_rows: DataFrame, iris_year: DataFrame, linked: DataFrame, polygons: DataFrame, cutoff: str = REFORM, statuses=CERTAIN, lot_id: str = "match_id") -> dict[str, DataFrame]:
    """Name of each part -> its rows. The two folds of the linked lots are shared by all parts."""
    points = fold.points(linked, lot_id=lot_id)
    impact = fold.impact_points(linked, lot_id=lot_id)
    years = sorted(r["annee"] for r in market_rows.select("annee").where(F.col("annee").isNotNull()).distinct().collect())  # a few dozen at most
    out = {
        "meta": marts.years_and_dates(market_rows, linked),
        "meta.appariement": marts.matching_rate(linked, statuses),
        "marche.communes": market_rows,
        "marche.global": marts.trend_by_type(points),
        "impact.cube": marts.impact_cube(impact, cutoff, statuses),
        "impact.comptages": marts.impact_counts_by_year(impact, cutoff, statuses),
        "impact.echelle": marts.label_ladder(impact, cutoff, statuses),
        "communes.appariement": marts.town_matching(linked),
        "iris": marts.iris_year_sums(iris_year),
        "iris.geojson": sinks.slim_features(polygons),
    }
    if years:
        out["communes.tableau"] = marts.town_table(market_rows, years[-1], int(years[-1]) - int(years[0]))
    return out


def export(parts: dict[str, DataFrame], folder: str) -> None:
    """One folder of JSON lines per part."""
    for name, rows in parts.items():
        sinks.write_cube(rows, f"{folder}/{name}")
