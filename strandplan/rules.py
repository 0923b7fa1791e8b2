"""Design rules and the equipment catalog, as values and as small tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Rules:
    """Fixed values of the design rules; money in cents, lengths in metres."""

    max_area_units: int = 432
    max_drop_m: int = 150
    max_route_m: int = 20_000
    take_pct: int = 65
    spare_pct: int = 10
    floor_permille: int = 950
    drop_assembly: int = 12_000
    drop_cable_m: int = 150
    optics_port: int = 8_500
    chassis_slots: int = 16
    chassis: int = 1_800_000
    head_end_site: int = 12_000_000
    max_areas: int = 512
    #: Penalties of the composite score.
    street_crossing: int = 50_000
    drop_crossing: int = 20_000
    odd_terminal: int = 100_000
    ring: int = 500_000
    qa_error: int = 1_000_000


RULES = Rules()

#: Fixed values of the catalog: (size, unit cost in cents).
CABLES = ((12, 95), (24, 130), (48, 210), (96, 340), (144, 470), (288, 780))
SPLITTERS = ((2, 4_000), (4, 6_000), (8, 9_000), (16, 12_000), (32, 18_000))
TERMINALS = ((2, 8_000), (4, 12_000), (6, 15_000), (8, 18_000), (12, 25_000))
CABINETS = ((12, 30_000), (24, 45_000), (48, 65_000), (96, 90_000), (144, 120_000), (288, 180_000), (432, 250_000))
OLT_CARDS = ((1, 15_000), (2, 22_000), (4, 40_000), (8, 70_000), (16, 120_000))
#: By surface: 0 soft, 1 asphalt; cents a metre.
TRENCH = ((0, 4_500), (1, 15_000))

CATALOG = {"cable": CABLES, "splitter": SPLITTERS, "terminal": TERMINALS, "cabinet": CABINETS, "olt_card": OLT_CARDS, "trench": TRENCH}


def catalog(spark: SparkSession, family: str) -> DataFrame:
    """``(size, cost)`` of a family; a handful of rows."""
    return spark.createDataFrame(list(CATALOG[family]), "size int, cost long")


def values_sql(family: str) -> str:
    """The family as a SQL VALUES list."""
    return ", ".join(f"({s}, {c})" for s, c in CATALOG[family])
