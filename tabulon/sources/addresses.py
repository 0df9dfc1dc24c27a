"""Slices of the published cube by address: what a link says after ``#``, the manifest it is read against, and the files it needs.

An address is ``restriction/tier/from..to/side``, then parts in any order: ``cut``, ``show:<view>``, ``card:<id>``. Whatever is missing or isn't
in the manifest's vocabulary falls to its default; a range of months is clamped to those published. A cube that is stored by ban list, tier
and month is read by partition, so a slice reads its own files only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDES, VIEWS, ALL = ("corp", "runner"), ("all", "in", "out", "splash"), "all"
ID = re.compile(r"[a-z0-9_]{1,80}\Z")
RANGE = re.compile(r"(\d{4}-\d{2})\.\.(\d{4}-\d{2})\Z")
#: Where the slices of a version are.
PATHS = {"summary": "summary/{side}/{restriction}/{tier}.json", "summary_cut": "summary_cut/{side}/{restriction}/{tier}.json", "identities": "identities/{side}/{restriction}/{tier}.json", "trends": "trends/{side}/{restriction}/{tier}.json", "tournaments": "tournaments/{restriction}/{tier}.json"}
PARTITIONS = ["restriction_id", "tier", "month"]


@dataclass(frozen=True)
class Slice:
    restriction: str = ALL
    tier: str = ALL
    start: str | None = None
    end: str | None = None
    side: str = "corp"
    chosen: bool = False
    cut: bool = False
    show: str = ALL
    card: str | None = None

    def address(self) -> str:
        """The link of a slice. A range is written only where it was chosen: other links follow the newest months."""
        months = f"{self.start}..{self.end}" if self.chosen else ""
        extra = ["cut"] * self.cut + [f"show:{self.show}"] * (self.show != ALL) + [f"card:{self.card}"] * (self.card is not None)
        return "#" + "/".join([self.restriction, self.tier, months, self.side, *extra])

    def of_side(self, side: str, side_of_card=lambda card: None) -> Slice:
        """The same on another side; a card of the old side is closed."""
        return replace(self, side=side, card=self.card if self.card and side_of_card(self.card) == side else None)

    def data_address(self) -> str:
        """The address without what changes no data: equal ones need no new reading."""
        return replace(self, show=ALL, card=None).address()


def clamped(start: str, end: str, months: list[str]) -> tuple[str, str] | None:
    """A range of months within those published; None where it isn't a range or lies outside."""
    if not months or start > end or end < months[0] or start > months[-1]:
        return None
    return max(start, months[0]), min(end, months[-1])


def newest(months: list[str], n: int) -> tuple[str | None, str | None]:
    """The last n calendar months that end with the last published one, from the first published one on."""
    if not months:
        return None, None
    year, month = map(int, months[-1].split("-"))
    first = year * 12 + month - 1 - (n - 1)
    return max(f"{first // 12:04}-{first % 12 + 1:02}", months[0]), months[-1]


def parse(address: str | None, manifest: dict, is_card=lambda card: True) -> Slice:
    parts = (address or "").removeprefix("#").split("/") + [""] * 4
    known = lambda part, values, default: part if part in values else default
    start, end = newest(manifest["months"], manifest["period_months"])
    asked = RANGE.match(parts[2])
    span = clamped(*asked.groups(), manifest["months"]) if asked else None
    s = Slice(known(parts[0], [r["id"] for r in manifest["restrictions"]], ALL), known(parts[1], [t["id"] for t in manifest["tier_groups"]], ALL), *(span or (start, end)), known(parts[3], SIDES, "corp"), span is not None)
    rest = parts[4:]
    shown = [v for k, _, v in (p.partition(":") for p in rest) if k == "show" and v in VIEWS and v != ALL]
    cards = [v for k, _, v in (p.partition(":") for p in rest) if k == "card" and ID.match(v) and is_card(v)]
    return replace(s, cut="cut" in rest and "summary_cut" in manifest.get("paths", {}), show=shown[0] if shown else ALL, card=cards[0] if cards else None)


def path(manifest: dict, kind: str, side: str = "corp", restriction: str = ALL, tier: str = ALL) -> str:
    """The path of a slice's file from the manifest alone; names that could lead elsewhere are refused."""
    if kind not in manifest["paths"]:
        raise ValueError(f"unknown kind of slice: {kind}")
    if side not in SIDES or not ID.match(restriction) or not ID.match(tier):
        raise ValueError("not a slice")
    return manifest["base_path"] + manifest["paths"][kind].format(side=side, restriction=restriction, tier=tier)


def manifest(counts: DataFrame, version: str, thresholds: dict, period_months: int, paths: dict[str, str] = PATHS, names: dict[str, str] | None = None) -> dict:
    """What a version holds: vocabulary, thresholds and paths. The driver gets the distinct ban lists, tiers and months of the cube."""
    some = lambda c: [r[0] for r in counts.select(c).distinct().orderBy(c).collect()]
    named = lambda ids: [{"id": ALL, "name": (names or {}).get(ALL, ALL)}, *[{"id": i, "name": (names or {}).get(i, i)} for i in ids]]
    return {"base_path": f"v={version}/", "sides": list(SIDES), "restrictions": named(some("restriction_id")), "tier_groups": named(some("tier")), "months": some("month"), "period_months": period_months, "thresholds": thresholds, "paths": paths}


def store(counts: DataFrame, folder: str) -> None:
    """The cube by ban list, tier and month; rows are dealt by these, large ones to several tasks, so that a task sorts few rows and a folder has few files."""
    counts.hint("rebalance", *PARTITIONS).write.mode("overwrite").partitionBy(*PARTITIONS).parquet(folder)


def rows(spark: SparkSession, folder: str, s: Slice) -> DataFrame:
    """The stored counts that a slice adds up: conditions on partitions first, so other files aren't read."""
    cube = spark.read.parquet(folder).withColumn("month", F.col("month").cast("string"))
    for column, value in (("restriction_id", s.restriction), ("tier", s.tier)):
        cube = cube.filter(F.col(column) == value) if value != ALL else cube
    cube = cube.filter(F.col("month").between(s.start, s.end)) if s.start else cube.filter(F.lit(False))
    return cube.filter(F.col("side") == s.side) if s.card is None else cube.filter((F.col("side") == s.side) & (F.col("card_id") == s.card))

