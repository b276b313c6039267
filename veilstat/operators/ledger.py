"""Budget ledger: what a program of releases spends, per mechanism, and in sum."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilstat.operators.zcdp import eps_to_rho


@dataclass
class Ledger:
    """Releases with eps (pure) or rho (zCDP); `uses` counts how often one is spent, as for dimensions or candidates."""

    entries: list[tuple[str, str, float, float, int]] = field(default_factory=list)

    def spend(self, release: str, mechanism: str, eps: float = 0.0, rho: float = 0.0, uses: int = 1) -> None:
        if min(eps, rho) < 0 or uses < 1:
            raise ValueError("a budget cannot be negative")
        self.entries.append((release, mechanism, float(eps), float(rho), uses))

    def total_eps(self) -> float:
        return sum(e * u for _, _, e, _, u in self.entries)

    def total_rho(self, delta: float | None = None) -> float:
        """Pure releases count eps^2 / 2 each; with delta, as the rho that gives their eps at that delta."""
        pure = [(e, u) for _, _, e, _, u in self.entries if e and not math.isinf(e)]
        return sum((e * e / 2 if delta is None else eps_to_rho(e, delta)) * u for e, u in pure) + sum(r * u for *_, r, u in self.entries)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.entries, "release string, mechanism string, eps double, rho double, uses int")


def split(eps: float, share: float) -> tuple[float, float]:
    """(eps of the estimate, eps of its distribution)."""
    if not 0 <= share <= 1:
        raise ValueError("a share lies between 0 and 1")
    return share * eps, (1 - share) * eps


def study_ledger(eps: float, share: float, search_candidates: int, dims: int = 1, fixed: bool = False) -> Ledger:
    """The estimate and the search, per dimension.

    With `fixed` the noise of the threshold is drawn once. Without it is drawn at every candidate, as the compared
    method does, and each of these draws is charged: the program then spends more than eps.
    """
    own, rest = split(eps, share)
    book = Ledger()
    book.spend("estimate", "inverse sensitivity", own, uses=dims)
    book.spend("threshold", "AboveThreshold", rest / 2, uses=dims if fixed else dims * max(1, search_candidates))
    book.spend("queries", "AboveThreshold", rest / 2, uses=dims)
    return book


def study_releases(eps: Column, share: float, search_candidates: int, dims: int = 1, fixed: bool = False) -> Column:
    """`study_ledger` of every row: an array of (release, each, uses, spent)."""
    entry = lambda name, part, uses: F.struct(F.lit(name).alias("release"), (eps * F.lit(part)).alias("each"), F.lit(uses).alias("uses"), (eps * F.lit(part) * F.lit(uses)).alias("spent"))
    own, rest = split(1.0, share)
    return F.array(entry("estimate", own, dims), entry("threshold", rest / 2, dims if fixed else dims * max(1, search_candidates)), entry("queries", rest / 2, dims))
