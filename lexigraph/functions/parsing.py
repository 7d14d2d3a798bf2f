"""What people type: coordinates and radii; and how results are shown."""

from __future__ import annotations

import re
import unicodedata

# Kilometres in each unit.
UNITS = {"m": 0.001, "km": 1.0, "mi": 1.609344, "ft": 0.0003048, "yd": 0.0009144, "nmi": 1.852}
# Longer names of units.
NAMES = {"metre": "m", "metres": "m", "meter": "m", "meters": "m", "kilometre": "km", "kilometres": "km", "kilometer": "km", "kilometers": "km", "kms": "km", "mile": "mi", "miles": "mi", "foot": "ft", "feet": "ft", "yard": "yd", "yards": "yd", "nm": "nmi"}
MAX_RADIUS = 20_000.0

_PART = re.compile(
    r"""\s* (?P<before>[NSEW])? \s*
    (?P<sign>[+-])? (?P<degrees>\d+(?:\.\d+)?)
    (?: \s* (?:°|º|deg(?:rees)?|d) \s* (?: (?P<minutes>\d+(?:\.\d+)?) \s* (?:'|m(?:in)?) \s* )? (?: (?P<seconds>\d+(?:\.\d+)?) \s* (?:"|s(?:ec)?) )? )?
    \s* (?P<after>[NSEW])? \s* (?:,|;|/|$|\s)""",
    re.I | re.X,
)
_MARKS = str.maketrans({"′": "'", "’": "'", "‘": "'", "″": '"', "“": '"', "”": '"', "−": "-", "–": "-"})


def parse_coordinates(text: str) -> tuple[float, float] | None:
    """(lat, lon) from decimal degrees, degrees with minutes and seconds, and hemisphere letters.

    None if the text doesn't look like coordinates; ValueError if it does but can't be.
    """
    text = unicodedata.normalize("NFC", text).translate(_MARKS).replace("''", '"').strip()
    if not text or not re.search(r"\d", text):
        return None
    parts, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if not m:
            return None
        parts.append(m)
        at = m.end()
    if len(parts) != 2 or any(m["before"] and m["after"] for m in parts):
        return None
    angles = [_angle(m) for m in parts]
    axes = ["" if not letter else "lat" if letter in "NS" else "lon" for _, letter in angles]
    if axes[0] and axes[0] == axes[1]:
        raise ValueError("two latitudes or two longitudes")
    swapped = axes[0] == "lon" or axes[1] == "lat"
    lat, lon = (x for x, _ in (reversed(angles) if swapped else angles))
    for name, x, most in (("latitude", lat, 90), ("longitude", lon, 180)):
        if abs(x) > most:
            raise ValueError(f"{name} {x:g} is out of range")
    return lat, lon


def _angle(m: re.Match) -> tuple[float, str]:
    """(degrees, hemisphere letter or '') of one coordinate; a sign and a letter contradict each other."""
    letter = (m["before"] or m["after"] or "").upper()
    if letter and m["sign"]:
        raise ValueError("a coordinate has a sign or a letter, not both")
    minutes, seconds = float(m["minutes"] or 0), float(m["seconds"] or 0)
    if max(minutes, seconds) >= 60:
        raise ValueError("minutes and seconds must be below 60")
    size = float(m["degrees"]) + minutes / 60 + seconds / 3600
    return (-size if m["sign"] == "-" or letter in ("S", "W") else size), letter


def parse_radius(text: str) -> float:
    """Kilometres from a number with a unit (km if none). A comma before three digits groups thousands, any other is a decimal point."""
    m = re.fullmatch(r"\s*([\d.,]+)\s*([a-z]*)\s*", text.lower())
    if not m:
        raise ValueError(f"{text!r} isn't a distance")
    number = m[1]
    number = number.replace(",", "") if re.fullmatch(r"\d{1,3}(,\d{3})+(\.\d+)?", number) else number.replace(",", ".")
    unit = NAMES.get(m[2], m[2]) or "km"
    if unit not in UNITS:
        raise ValueError(f"unknown unit {m[2]!r}")
    try:
        km = float(number) * UNITS[unit]
    except ValueError:
        raise ValueError(f"{text!r} isn't a distance") from None
    if not 0 < km <= MAX_RADIUS:
        raise ValueError("the radius must be more than 0 and at most 20,000 km")
    return km


def format_distance(km: float) -> str:
    return f"{km * 1000:.0f} m" if km < 1 else f"{km:.1f} km" if km < 100 else f"{km:,.0f} km"


def format_radius(km: float) -> str:
    return f"{km * 1000:.0f} m" if km < 1 else f"{km:,.10g} km"


def format_score(score: float, metric: str) -> str:
    """Links as a whole number; shares of a rank in millionths."""
    return f"{score:,.0f}" if metric == "indegree" else f"{score * 1e6:,.1f}"


def format_coords(lat: float, lon: float) -> str:
    return f"{abs(lat):.4f}° {'N' if lat >= 0 else 'S'}, {abs(lon):.4f}° {'E' if lon >= 0 else 'W'}"


def human_size(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} TB"
