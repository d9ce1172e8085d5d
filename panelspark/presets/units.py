"""Fixed values of the territorial unit source."""

from __future__ import annotations

# Fixed value: nested schema of one unit in the territory listing.
UNIT_SCHEMA = (
    "id long, nome string, "
    "microrregiao struct<id: long, nome: string, mesorregiao: struct<id: long, nome: string>>, "
    "`regiao-imediata` struct<id: long, nome: string, "
    "`regiao-intermediaria`: struct<id: long, nome: string, "
    "UF: struct<id: long, sigla: string, nome: string, "
    "regiao: struct<id: long, sigla: string, nome: string>>>>"
)

# Units that are not ordinary municipalities.
SPECIAL_TYPES = {"2605459": "distrito_estadual", "5300108": "distrito_federal"}
DEFAULT_TYPE = "municipio"

LEGACY_LEVELS = ("mesorregiao", "codigo_mesorregiao", "microrregiao", "codigo_microrregiao")
IDENTITY = ("codigo_ibge", "municipio", "municipio_normalized", "uf", "regiao",
            "regiao_imediata", "codigo_regiao_imediata", "tipo_unidade_territorial")

# Code shapes.
CODE_PATTERNS = {
    "codigo_ibge": "[0-9]{7}",
    "codigo_uf_ibge": "[0-9]{2}",
    "codigo_regiao": "[1-5]",
    "codigo_regiao_imediata": "[0-9]{6}",
    "codigo_regiao_intermediaria": "[0-9]{4}",
}
REQUIRED = ("codigo_ibge", "municipio", "sigla_uf", "codigo_uf_ibge", "regiao")
EXAMPLES = ("2605459", "3304557", "3550308", "4202404", "5300108")
