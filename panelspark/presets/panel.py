"""Fixed values of the land-cover panel source."""

from __future__ import annotations

from panelspark.sources.contracts import Contract

# The leading columns of the wide sheet, in order.
WIDE_PREFIX = ("ID", "country", "biome", "region", "state", "geocode", "municipality",
               "municipality-state", "class", "class_level_0", "class_level_1", "class_level_2",
               "class_level_3", "class_level_4")

LEGEND_CONTRACT = Contract(
    "class legend", ("class_id", "class_name_pt_br", "class_name_en", "hex_code"),
    {"class_id": "int"})

# Official class names and hierarchy branches the indicators are built from.
CLASS_NAMES = {"urban": "Área Urbanizada", "water": "Rio, Lago e Oceano",
               "wetland": "Campo Alagado e Área Pantanosa"}
BRANCHES = {
    "native_vegetation": ("1. Forest", "2. Herbaceous and Shrubby Vegetation"),
    "agriculture_livestock": ("3. Farming",),
}
NOT_OBSERVED = "Not Observed"

# Horizons and quality thresholds.
HORIZONS = (5, 10, 20)
COVERAGE_THRESHOLD_PCT = 99.0
VARIATION_WARNING_PCT = 0.1
VARIATION_FAILURE_PCT = 1.0
PERCENTAGE_TOLERANCE = 1e-9
AREA_TOLERANCE = 1e-8
