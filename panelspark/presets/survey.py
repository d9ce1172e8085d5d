"""Fixed values of the municipal survey source."""

from __future__ import annotations

# Name of each field and the survey column it comes from.
IDENTITY_COLUMNS = {"codigo_ibge": "CodMun", "sigla_uf_fonte": "UF", "municipio_fonte": "Mun"}
PLANNING_COLUMNS = {
    "flood_planning_master_plan": "Mgrd171",
    "flood_planning_land_use_law": "Mgrd172",
    "flood_planning_specific_law": "Mgrd173",
    "landslide_planning_master_plan": "Mgrd174",
    "landslide_planning_land_use_law": "Mgrd175",
    "landslide_planning_specific_law": "Mgrd176",
}
DIRECT_COLUMNS = {
    "flood_risk_mapping": "Mgrd181",
    "flood_contingency_plan": "Mgrd184",
    "flood_early_warning": "Mgrd186",
    "landslide_risk_mapping": "Mgrd201",
    "landslide_contingency_plan": "Mgrd204",
    "landslide_early_warning": "Mgrd206",
    "municipal_civil_defense_body": "Mgrd212",
    "civil_defense_budget_provision": "Mgrd225",
    "civil_defense_early_warning": "Mgrd2213",
}
UNKNOWN_COLUMN = "Mgrd216"
OVERRIDDEN = "municipal_civil_defense_body"
COMBINED = "any_risk_prevention_planning_instrument"

STATUS_COLUMNS = tuple(
    f"{name}_status" for name in
    (*PLANNING_COLUMNS, COMBINED, *DIRECT_COLUMNS))

# The indicators published per unit.
PUBLISHED_INDICATORS = (
    "municipal_civil_defense_body", "civil_defense_budget_provision",
    "any_risk_prevention_planning_instrument", "flood_risk_mapping", "flood_contingency_plan",
    "flood_early_warning", "landslide_risk_mapping", "landslide_contingency_plan",
    "landslide_early_warning",
)
REFERENCE_YEAR = 2020

# Declared-yes counts of the 2020 release.
EXPECTED_YES = {
    "municipal_civil_defense_body_status": 4236,
    "flood_risk_mapping_status": 2164,
    "flood_contingency_plan_status": 1407,
    "flood_early_warning_status": 436,
    "landslide_contingency_plan_status": 1016,
    "landslide_early_warning_status": 246,
    "civil_defense_budget_provision_status": 968,
    "civil_defense_early_warning_status": 435,
}
