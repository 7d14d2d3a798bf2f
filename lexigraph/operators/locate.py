"""From what is typed to a place: coordinates, or an article that has some."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import format_coords, parse_coordinates
from . import titles


@dataclass
class Location:
    lat: float
    lon: float
    label: str
    page_id: int | None = None


@dataclass
class Resolution:
    """A location, or several to choose from, or why there is none."""

    location: Location | None = None
    choices: list[Location] = field(default_factory=list)
    note: str = ""


def suggest(index: DataFrame, places: DataFrame, text: str, limit: int = 10) -> DataFrame:
    """Title matches that are places, in the order of the matches."""
    found = titles.search(index, text, 5 * limit)
    return found.join(places.select(F.col("page_id").alias("target")), "target", "left_semi").orderBy("place").limit(limit)


def resolve(index: DataFrame, places: DataFrame, text: str) -> Resolution:
    """Coordinates if the text is some; else the best title match.

    If that match has no coordinates, the only other exact or prefix match with coordinates
    stands in; of two and more the reader must choose.
    """
    try:
        point = parse_coordinates(text)
    except ValueError as e:
        return Resolution(note=str(e))
    if point:
        return Resolution(Location(*point, format_coords(*point)))
    found = titles.search(index, text, 60)
    rows = found.join(places.select(F.col("page_id").alias("target"), "lat", "lon"), "target", "left").orderBy("place").collect()
    if not rows:
        return Resolution(note=f"nothing is called {text!r}")
    at = lambda r: Location(r.lat, r.lon, r.article, r.target)
    if rows[0].lat is not None:
        return Resolution(at(rows[0]))
    usable = [at(r) for r in rows if r.lat is not None and r.how in ("exact", "prefix")]
    if len(usable) == 1:
        return Resolution(usable[0], note=f"{rows[0].article} has no coordinates")
    return Resolution(choices=usable, note=f"{rows[0].article} has no coordinates")
