"""Names of band-power features, and groups of them by side and region."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The parts of feature names, the labels of a recording, and frequency bands (Hz).
SIDES = ("left", "right")
REGIONS = ("acc", "ofc")
BANDS = {"delta": (1, 4), "theta": (4, 8), "alpha": (8, 12), "beta": (12, 30), "Lgamma": (30, 70), "Hgamma": (70, 100)}
ACUTE_BANDS = ((1, 4), (4, 8), (8, 12), (12, 20), (20, 30), (30, 55), (65, 100))
CHRONIC_LABELS = ("nrs", "vas", "mpq", "relativenrs", "relativevas", "unpnrs", "unpvas", "reliefnrs", "reliefvas", "mood", "righttimes")
ACUTE_LABELS = ("pain", "time", "temp", "bodyside")


def feature_names(sides: tuple[str, ...] = SIDES) -> list[str]:
    return [f"{s}{r}{b}" for s in sides for r in REGIONS for b in BANDS]


@dataclass(frozen=True)
class FeatureSet:
    """Features of some sides and regions; ``None``: of all."""

    name: str
    side: str | None = None
    region: str | None = None

    def columns(self, names: list[str]) -> list[str]:
        tokens = [t for t in (self.side, self.region) if t]
        known = re.compile(rf"^({'|'.join(SIDES)})({'|'.join(REGIONS)})({'|'.join(BANDS)})$")
        return [n for n in names if known.match(n) and all(t in n for t in tokens)]


def feature_sets(sides: tuple[str, ...] = SIDES) -> list[FeatureSet]:
    """The nine sets of two-sided recordings, the three of one-sided ones."""
    if len(sides) == 1:
        return [FeatureSet("both regions")] + [FeatureSet(r, sides[0], r) for r in REGIONS]
    sets = [FeatureSet("bilateral ofc/acc")] + [FeatureSet(f"{s} ofc/acc", s) for s in sides]
    sets += [FeatureSet(f"bilateral {r}", None, r) for r in REGIONS]
    return sets + [FeatureSet(f"{s} {r}", s, r) for s in sides for r in REGIONS]


def matching(names: list[str], region: str, band: str, side: str) -> list[str]:
    return [n for n in names if region in n and band in n and side in n]
