"""Fixed values of the disaster event source: contract, classification and catalogue."""

from __future__ import annotations

from panelspark.sources.contracts import Contract

# The source columns in contract order, the name each gets and how it is read.
# Kinds: text, blank (text, blank becomes null), date, typology, count, money.
FIELDS = (
    ("Protocolo_S2iD", "source_event_id", "text"),
    ("Nome_Municipio", "municipality_name_source", "text"),
    ("Sigla_UF", "uf_code_source", "text"),
    ("regiao", "region_name_source", "text"),
    ("Data_Registro", "registration_date", "date"),
    ("Data_Evento", "event_date", "date"),
    ("Cod_Cobrade", "cobrade_code", "text"),
    ("tipologia", "atlas_type_id", "typology"),
    ("descricao_tipologia", "atlas_type_name_source", "text"),
    ("grupo_de_desastre", "atlas_group_name_source", "text"),
    ("Cod_IBGE_Mun", "codigo_ibge", "text"),
    ("Setores Censitários", "census_sectors_source", "blank"),
    ("Status", "status_source", "text"),
    ("DH_Descricao", "human_damage_description", "blank"),
    ("DH_MORTOS", "deaths", "count"),
    ("DH_FERIDOS", "injured", "count"),
    ("DH_ENFERMOS", "ill", "count"),
    ("DH_DESABRIGADOS", "homeless", "count"),
    ("DH_DESALOJADOS", "displaced", "count"),
    ("DH_DESAPARECIDOS", "missing", "count"),
    ("DH_AFETADOS_SECA_ESTIAGEM", "drought_affected", "count"),
    ("DH_total_danos_humanos_diretos", "direct_human_damage_total", "count"),
    ("DH_OUTROS AFETADOS", "other_affected", "count"),
    ("DM_Descricao", "material_damage_description", "blank"),
    ("DM_Uni Habita Danificadas", "housing_units_damaged", "count"),
    ("DM_Uni Habita Destruidas", "housing_units_destroyed", "count"),
    ("DM_Uni Habita Valor", "housing_damage_brl", "money"),
    ("DM_Inst Saúde Danificadas", "health_facilities_damaged", "count"),
    ("DM_Inst Saúde Destruidas", "health_facilities_destroyed", "count"),
    ("DM_Inst Saúde Valor", "health_facilities_damage_brl", "money"),
    ("DM_Inst Ensino Danificadas", "education_facilities_damaged", "count"),
    ("DM_Inst Ensino Destruidas", "education_facilities_destroyed", "count"),
    ("DM_Inst Ensino Valor", "education_facilities_damage_brl", "money"),
    ("DM_Inst Serviços Danificadas", "service_facilities_damaged", "count"),
    ("DM_Inst Serviços Destruidas", "service_facilities_destroyed", "count"),
    ("DM_Inst Serviços Valor", "service_facilities_damage_brl", "money"),
    ("DM_Inst Comuni Danificadas", "community_facilities_damaged", "count"),
    ("DM_Inst Comuni Destruidas", "community_facilities_destroyed", "count"),
    ("DM_Inst Comuni Valor", "community_facilities_damage_brl", "money"),
    ("DM_Obras de Infra Danificadas", "infrastructure_works_damaged", "count"),
    ("DM_Obras de Infra Destruidas", "infrastructure_works_destroyed", "count"),
    ("DM_Obras de Infra Valor", "infrastructure_damage_brl", "money"),
    ("DM_total_danos_materiais", "material_damage_total_brl", "money"),
    ("DA_Descricao", "environmental_damage_description", "blank"),
    ("DA_Polui/cont da água", "water_pollution_impact_source", "text"),
    ("DA_Polui/cont do ar", "air_pollution_impact_source", "text"),
    ("DA_Polui/cont do solo", "soil_pollution_impact_source", "text"),
    ("DA_Dimi/exauri hídrico", "water_depletion_impact_source", "text"),
    ("DA_Incêndi parques/APA's/APP's", "protected_area_fire_impact_source", "text"),
    ("PEPL_Descricao", "public_loss_description", "blank"),
    ("PEPL_Assis_méd e emergên(R$)", "public_health_emergency_loss_brl", "money"),
    ("PEPL_Abast de água pot(R$)", "public_water_supply_loss_brl", "money"),
    ("PEPL_sist de esgotos sanit(R$)", "public_sewerage_loss_brl", "money"),
    ("PEPL_Sis limp e rec lixo (R$)", "public_waste_management_loss_brl", "money"),
    ("PEPL_Sis cont pragas (R$)", "public_pest_control_loss_brl", "money"),
    ("PEPL_distrib energia (R$)", "public_energy_distribution_loss_brl", "money"),
    ("PEPL_Telecomunicações (R$)", "public_telecommunications_loss_brl", "money"),
    ("PEPL_Tran loc/reg/l_curso (R$)", "public_transport_loss_brl", "money"),
    ("PEPL_Distrib combustíveis(R$)", "public_fuel_distribution_loss_brl", "money"),
    ("PEPL_Segurança pública (R$)", "public_safety_loss_brl", "money"),
    ("PEPL_Ensino (R$)", "public_education_loss_brl", "money"),
    ("PEPL_total_publico", "public_loss_total_brl", "money"),
    ("PEPR_Descricao", "private_loss_description", "blank"),
    ("PEPR_Agricultura (R$)", "private_agriculture_loss_brl", "money"),
    ("PEPR_Pecuária (R$)", "private_livestock_loss_brl", "money"),
    ("PEPR_Indústria (R$)", "private_industry_loss_brl", "money"),
    ("PEPR_Comércio (R$)", "private_commerce_loss_brl", "money"),
    ("PEPR_Serviços (R$)", "private_services_loss_brl", "money"),
    ("PEPR_total_privado", "private_loss_total_brl", "money"),
    ("PE_PLePR", "public_private_loss_total_brl", "money"),
)

EVENT_CONTRACT = Contract("event source", tuple(source for source, _, _ in FIELDS))
COUNT_COLUMNS = tuple(target for _, target, kind in FIELDS if kind == "count")
MONEY_COLUMNS = tuple(target for _, target, kind in FIELDS if kind == "money")
NON_NEGATIVE = COUNT_COLUMNS + ("reported_affected_total",) + MONEY_COLUMNS

# Classification of rain-related codes and its version stamp.
CLASSIFICATION_VERSION = "atlas_cobrade_rain_v1"
RAIN_CATALOGUE = (
    (1, "Alagamentos", ("12300",)),
    (2, "Enxurradas", ("12200",)),
    (7, "Inundações", ("12100",)),
    (8, "Movimento de Massa",
     ("11311", "11312", "11313", "11314", "11321", "11331", "11332", "11340")),
    (13, "Chuvas Intensas", ("13214",)),
)
RAIN_TYPE_IDS = tuple(type_id for type_id, _, _ in RAIN_CATALOGUE)
RAIN_CODES = tuple(sorted(code for _, _, codes in RAIN_CATALOGUE for code in codes))
HYDROLOGICAL_PREFIX = "12"
GEOLOGICAL_PREFIX = "11"
STATUSES = ("Registro", "Reconhecido")
RECOGNIZED_STATUS = "Reconhecido"

# Shape of the event protocol, monetary index and its reference row.
PROTOCOL_PATTERN = "[A-Z]{2}-[A-Z]-[0-9]{7}-[0-9]{5}-[0-9]{8}"
CORRECTION_INDEX = "IGP-DI"
CORRECTION_REFERENCE = {"year": 2025, "index": 1167.239, "zero_years": (1991, 1994)}
MONEY_TOLERANCE = 0.05

# Totals and the parts they must equal.
HUMAN_TOTALS = {
    "direct_human_damage_total": ("deaths", "injured", "ill", "homeless", "displaced",
                                  "missing", "drought_affected"),
    "reported_affected_total": ("direct_human_damage_total", "other_affected"),
}
MONEY_TOTALS = {
    "material_damage_total_brl": (
        "housing_damage_brl", "health_facilities_damage_brl", "education_facilities_damage_brl",
        "service_facilities_damage_brl", "community_facilities_damage_brl",
        "infrastructure_damage_brl"),
    "public_loss_total_brl": tuple(
        c for c in MONEY_COLUMNS if c.startswith("public_") and not c.endswith("total_brl")),
    "private_loss_total_brl": tuple(
        c for c in MONEY_COLUMNS if c.startswith("private_") and not c.endswith("total_brl")),
    "public_private_loss_total_brl": ("public_loss_total_brl", "private_loss_total_brl"),
}

IMPACT_COLUMNS = ("deaths", "injured", "homeless", "displaced", "direct_human_damage_total",
                  "reported_affected_total")
DAMAGE_SHEETS = ("Atlas Valores Originais", "Atlas Valores Corrigidos")
WORKBOOK_SHEETS = DAMAGE_SHEETS + ("Cálculo Correção", "Grupos de Desastres")
LOG_SHEETS = ("Lista", "População", "Protocolos Corrigidos", "Protocolos não relacionados")
