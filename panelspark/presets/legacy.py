"""Fixed values of the transitional municipal listing and its samples."""

from __future__ import annotations

# Labels of the rain-related typologies in the listing.
TYPE_LABELS = {"1": "Alagamentos", "2": "Enxurradas", "7": "Inundações", "8": "Movimento de massa",
               "13": "Chuvas intensas"}
CENSUS_YEAR = 2022

# Sample units, one capital per state, the demonstration unit and three edge cases.
SAMPLE_CODES = (
    "1200401", "2704302", "1600303", "1302603", "2927408", "2304400", "5300108", "3205309",
    "5208707", "2111300", "5103403", "5002704", "3106200", "1501402", "2507507", "4106902",
    "2611606", "2211001", "3304557", "2408102", "4314902", "1100205", "1400100", "4205407",
    "3550308", "2800308", "1721000", "4202404", "1200013", "2903953", "2106672",
)
STATES = 27
