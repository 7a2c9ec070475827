"""Dictionaries and parameters of the delivery domain.

Every table is passed to the operators as an argument, so other domains bring
their own.
"""

# The region of each state.
REGION_OF_STATE = {
    "DF": "Central-West", "GO": "Central-West", "MS": "Central-West", "MT": "Central-West",
    "AC": "North", "AM": "North", "AP": "North", "PA": "North", "RO": "North", "RR": "North",
    "TO": "North", "AL": "Northeast", "BA": "Northeast", "CE": "Northeast", "MA": "Northeast",
    "PB": "Northeast", "PE": "Northeast", "PI": "Northeast", "RN": "Northeast", "SE": "Northeast",
    "PR": "South", "RS": "South", "SC": "South", "ES": "Southeast", "MG": "Southeast",
    "RJ": "Southeast", "SP": "Southeast",
}

# The roles two regions play in the flags.
REMOTE_REGION = "North"
CORE_REGION = "Southeast"

# Seller states that count as remote.
REMOTE_SELLER_STATES = ["AC", "AM", "AP", "PA", "RO", "RR", "TO"]

# Handling complexity of product categories, and of all others.
COMPLEXITY_OF_CATEGORY = {
    "livros_interesse_geral": 1, "livros_tecnicos": 1, "musica": 1, "beleza_saude": 2,
    "cama_mesa_banho": 2, "utilidades_domesticas": 2, "brinquedos": 3, "eletronicos": 3,
    "esporte_lazer": 3, "ferramentas_jardim": 3, "informatica_acessorios": 3, "telefonia": 3,
    "eletrodomesticos": 4, "eletrodomesticos_2": 4, "eletroportateis": 4,
    "moveis_colchao_e_estofado": 5, "moveis_decoracao": 5, "moveis_escritorio": 5,
    "moveis_quarto": 5, "moveis_sala": 5,
}
DEFAULT_COMPLEXITY = 2

# Lower-case names of the state capitals.
CAPITAL_CITIES = [
    "aracaju", "belem", "belo horizonte", "boa vista", "brasilia", "campo grande",
    "cuiaba", "curitiba", "florianopolis", "fortaleza", "goiania", "joao pessoa",
    "macapa", "maceio", "manaus", "natal", "palmas", "porto alegre", "porto velho",
    "recife", "rio branco", "rio de janeiro", "salvador", "sao luis", "sao paulo",
    "teresina", "vitoria",
]

# States that count as next to a seller state (not symmetric).
NEIGHBOURS_OF_STATE = {
    "AM": ["AC", "MT", "PA", "RO", "RR"],
    "BA": ["AL", "ES", "GO", "MG", "PE", "PI", "SE", "TO"],
    "GO": ["BA", "DF", "MG", "MS", "MT", "TO"],
    "MG": ["BA", "DF", "ES", "GO", "MS", "MT", "RJ", "SP"],
    "PA": ["AM", "AP", "MA", "MT", "RR", "TO"],
    "PR": ["MS", "RS", "SC", "SP"],
    "RJ": ["ES", "MG", "SP"],
    "RS": ["PR", "SC"],
    "SC": ["PR", "RS"],
    "SP": ["GO", "MG", "MS", "PR", "RJ"],
}

# The hub point (latitude, longitude) and the platform launch day.
HUB_POINT = (-23.5505, -46.6333)
PLATFORM_LAUNCH = "2016-09-01"

# Month sets of the season flags.
HOLIDAY_MONTHS = [1, 2, 6, 12]
FAST_MONTHS = [7, 8, 9]
YEAR_END_MONTHS = [11, 12]

# Right-closed bin edges.
WEIGHT_EDGES = [0, 500, 1000, 2000, 5000, 10000, float("inf")]
FREIGHT_TIER_EDGES = [0, 10, 20, 50, float("inf")]
HOUR_BUCKET_EDGES = [-1, 8, 12, 18, 24]
HOLIDAY_WINDOW_EDGES = [0, 3, 7, 14, 30, 60, 365]

# Thresholds of the flags and of the screening verdict.
HEAVY_GRAMS = 5000
LONG_HEAVY = {"km": 500, "grams": 2000}
SHORT_HEAVY = {"km": 200, "grams": 5000}
LONGHAUL_KM = 1450
CHEAP_FREIGHT = 10
OVERSIZED_CM = 100
MIN_ABS_R = 0.03
MIN_SPREAD_DAYS = 1.0
MIN_SCREENING_ROWS = 100
MIN_ROUTE_ROWS = 10

TARGET = "estimated_delivery_days"
