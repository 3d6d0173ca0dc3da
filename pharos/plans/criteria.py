"""Ranking rules and sort expressions: parsing and errors."""

from __future__ import annotations

import re
from dataclasses import dataclass

DEFAULT_CRITERIA = ("words", "typo", "proximity", "attribute", "sort", "exactness")
_RESERVED = {"_geo", "_geoRadius", "_geoDistance"}


class CriterionError(ValueError):
    pass


@dataclass(frozen=True)
class Criterion:
    name: str  # words, typo, proximity, attribute, sort, exactness, asc, desc
    field: str | None = None


@dataclass(frozen=True)
class Sort:
    """``field`` or a geo point, ascending or descending."""

    field: str | None
    ascending: bool
    point: tuple[float, float] | None = None


def parse_criterion(text: str) -> Criterion:
    if text in DEFAULT_CRITERIA:
        return Criterion(text)
    try:
        s = parse_sort(text)
    except CriterionError:
        raise CriterionError(f"`{text}` isn't a ranking rule: use one of {', '.join(DEFAULT_CRITERIA)}, field:asc or field:desc") from None
    if s.point is not None:
        raise CriterionError(f"`{text}` can only be used when sorting at query time")
    return Criterion("asc" if s.ascending else "desc", s.field)


def parse_sort(text: str) -> Sort:
    name, colon, order = text.rpartition(":")
    if not colon or order not in ("asc", "desc") or not name:
        raise CriterionError(f"`{text}` must end in :asc or :desc")
    if name.startswith("_geoPoint"):
        m = re.fullmatch(r"_geoPoint\(\s*([^,\s]+)\s*,\s*([^,\s]+)\s*\)", name)
        if not m:
            raise CriterionError(f"`{name}` must be _geoPoint(latitude, longitude)")
        try:
            lat, lng = float(m[1]), float(m[2])
        except ValueError:
            raise CriterionError(f"`{name}` needs two numbers") from None
        if not -90 <= lat <= 90 or not -180 <= lng <= 180:
            raise CriterionError(f"`{name}` is out of range: latitudes go from -90 to 90, longitudes from -180 to 180")
        return Sort(None, order == "asc", (lat, lng))
    if name in _RESERVED or name.startswith("_geoRadius("):
        raise CriterionError(f"`{name}` is reserved; sort by _geoPoint(latitude, longitude)")
    return Sort(name, order == "asc")
