"""Parameters of a search run, checked once on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields

_TITLE = re.compile(r"[\w\s&/+().,'#-]{2,100}")
# Lowest and highest value of each number.
RANGES = {"hours_old": (1, 720), "max_pages": (1, 10), "max_per_source": (1, 2000), "max_per_keyword": (1, 500)}


@dataclass(frozen=True)
class SearchParams:
    titles: tuple[str, ...]
    hours_old: int = 24
    sources: tuple[str, ...] = ()
    max_pages: int = 3
    max_per_source: int = 600
    max_per_keyword: int = 100
    remote_only: bool = True
    include_duplicates: bool = False
    include_rejected: bool = False
    include_undated: bool = True
    errors: tuple[str, ...] = field(default=(), compare=False)

    @classmethod
    def parse(cls, body: dict) -> SearchParams:
        """The parameters of a request; ValueError with all complaints, one a line."""
        known = {f.name for f in fields(cls)} - {"errors"}
        wrong = [f"unknown key {k}" for k in sorted(set(body) - known)]
        titles = body.get("titles", ())
        if not isinstance(titles, (list, tuple)) or not 1 <= len(titles) <= 50:
            wrong.append("titles: 1 to 50 are needed")
        else:
            wrong += [f"titles: {t!r} isn't 2 to 100 usual characters" for t in titles if not isinstance(t, str) or not _TITLE.fullmatch(t.strip())]
        sources = body.get("sources", ())
        if not isinstance(sources, (list, tuple)) or len(sources) > 20:
            wrong.append("sources: at most 20")
        for name, (low, high) in RANGES.items():
            v = body.get(name, low)
            if isinstance(v, bool) or not isinstance(v, int) or not low <= v <= high:
                wrong.append(f"{name}: {low} to {high}")
        wrong += [f"{k}: true or false" for k in ("remote_only", "include_duplicates", "include_rejected", "include_undated") if not isinstance(body.get(k, True), bool)]
        if wrong:
            raise ValueError("\n".join(wrong))
        clean = dict.fromkeys(re.sub(r"\s+", " ", t).strip() for t in titles)
        first: dict[str, str] = {}
        for t in clean:
            first.setdefault(t.lower(), t)
        return cls(**{**body, "titles": tuple(first.values()), "sources": tuple(sources)})
