"""Fixed values of the published unit profile, version v1."""

from __future__ import annotations

SCHEMA_VERSION = "v1"
UNIVERSE = "ibge_current_5571"
RECORD_SCOPE = "five_rain_related_cobrade_typologies"
ZEROS_POLICY = "included_as_zero"
LEGACY_PROVENANCE = "transitional_legacy"
SURVEY_PROVENANCE = "self_reported_munic_2020"
SOURCES = ("ibge", "atlas", "mapbiomas", "munic_2020", "census_transitional_legacy",
           "transferegov_transitional_legacy")
EVENT_SOURCE = "Atlas Digital de Desastres/S2ID"
PANEL_SOURCE = "MapBiomas Brasil"
EVENT_UNIT = "registros"
PANEL_UNIT = "percentual"
WINDOW_YEARS = 10
EVENT_METRIC = "rain_related_event_count_10y"
CHANGE_METRICS = {"urban_change_20y_pct": "urban_area_ha",
                  "native_vegetation_change_20y_pct": "native_vegetation_area_ha"}
SHARE_METRICS = ("urban_area_pct", "native_vegetation_area_pct")
MAX_SHARD_BYTES = 24 * 1024 * 1024

# Sentences of the opening summary.
NO_RECORD_TEXT = "Nenhum registro foi encontrado nesta release do Atlas/S2ID."
FOUND_TEXT = "Desde %s, foram encontrados %d %s relacionados à chuva em %s."
RECORD_WORDS = ("registro", "registros")
TYPE_TEXT = " %s é o tipo mais frequente na série consultada."
LATEST_TEXT = " O registro mais recente é de %s."
AREA_TEXT = (" No território, a área classificada como urbanizada passou de %.2f km² em %d para "
             "%.2f km² em %d.")
