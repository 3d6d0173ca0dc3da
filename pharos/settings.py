"""Index settings, with the three states set, reset and left as they are."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field

from pharos.plans.criteria import DEFAULT_CRITERIA, parse_criterion

RESET = object()
_REINDEX = ("searchable", "stop_words", "synonyms", "exact_attributes")


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class Settings:
    """``searchable`` and ``displayed`` of None mean all fields; searchable order is importance."""

    primary_key: str | None = None
    searchable: tuple[str, ...] | None = None
    displayed: tuple[str, ...] | None = None
    filterable: tuple[str, ...] = ()
    sortable: tuple[str, ...] = ()
    distinct: str | None = None
    criteria: tuple[str, ...] = DEFAULT_CRITERIA
    stop_words: frozenset[str] = frozenset()
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    exact_words: frozenset[str] = frozenset()
    exact_attributes: tuple[str, ...] = ()
    authorize_typos: bool = True
    one_typo: int = 5
    two_typos: int = 9
    max_values_per_facet: int = 100
    pagination_max_total_hits: int | None = None

    def update(self, has_documents: bool = False, **changes) -> tuple[Settings, bool]:
        """(new settings, must derived tables be rebuilt?). ``RESET`` restores a default; a setting that
        isn't named stays."""
        known = {f.name: f for f in dataclasses.fields(self)}
        values = {}
        for k, v in changes.items():
            if k not in known:
                raise SettingsError(f"unknown setting {k}")
            if v is RESET:
                f = known[k]
                v = f.default_factory() if f.default is dataclasses.MISSING else f.default
            values[k] = tuple(v) if k in ("searchable", "displayed", "filterable", "sortable", "criteria", "exact_attributes") and v is not None else v
            if k in ("stop_words", "exact_words"):
                values[k] = frozenset(v)
        new = dataclasses.replace(self, **values)
        new.validate()
        if has_documents and new.primary_key != self.primary_key and self.primary_key is not None:
            raise SettingsError("the primary key can't change while the index holds documents")
        return new, any(getattr(new, k) != getattr(self, k) for k in _REINDEX) or new.faceted != self.faceted

    def validate(self) -> None:
        if self.one_typo > self.two_typos:
            raise SettingsError(f"one_typo ({self.one_typo}) can't be above two_typos ({self.two_typos})")
        for c in self.criteria:
            parse_criterion(c)

    @property
    def faceted(self) -> frozenset[str]:
        """Fields that need facet values: filterable, sortable, distinct and custom asc/desc fields."""
        custom = [parse_criterion(c) for c in self.criteria]
        return frozenset(self.filterable) | frozenset(self.sortable) | ({self.distinct} if self.distinct else set()) | {c.field for c in custom if c.field}

    def to_json(self) -> str:
        d = dataclasses.asdict(self)
        return json.dumps({k: sorted(v) if isinstance(v, frozenset) else v for k, v in d.items()}, ensure_ascii=False)

    @classmethod
    def from_json(cls, text: str) -> Settings:
        return cls().update(**json.loads(text))[0]
