"""Parameter tables.

FIXED VALUES - these must equal the values of the original flood-alert project for the results to
match. They are stated here plainly, in their natural order, and nowhere else.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: station dimension
# code, location, main river, base level m, status limit m (None = no fixed limit),
# event limit m (level above which a reading counts towards a flood event)
STATIONS = [
    ("A801", "Porto_Alegre", "Guaíba", 1.2, 3.0, 3.0),
    ("A803", "Santa_Maria", "Vacacaí_Mirim", 3.0, 4.5, 4.8),
    ("A827", "Caxias_do_Sul", "Rio_das_Antas", 2.5, 4.0, 4.0),
    ("A832", "Pelotas", "Canal_São_Gonçalo", 1.8, 2.8, 2.83),
]
DEFAULT_BASE_LEVEL = 2.0
DEFAULT_RIVER = "Rio_Local"
ALERT_FACTOR = 1.4          # level > base * 1.4 -> "alerta"
EVENT_FACTOR = 1.6          # event limit for stations without a fixed one = base * 1.6
HIGH_SEVERITY_FACTOR = 2.0  # max level > base * 2 -> "high"
CAPITAL = "Porto_Alegre"
CAPITAL_HIGH_LEVEL = 5.0    # Porto_Alegre max level > 5 m -> "high"
EVENT_MIN_ROWS = 24         # more than 24 critical readings -> one event
EVENT_SOURCE = "INMET_RS_Analysis"
WANTED_STATIONS = ["A801", "A803", "A827", "A832"]
STATUS_NAMES = ("normal", "alerta", "critico")
LEVEL_FLOOR = 0.5           # river level never drops below 0.5 m

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: header spellings of the raw station files, in order of preference
HEADER_ALIASES = {
    "datetime": ["Data", "DATA"],
    "hour": ["Hora UTC", "Hora", "HORA UTC", "HORA"],
    "precipitation_mm": ["PRECIPITACAO TOTAL, HORARIO (mm)", "PRECIPITAÇÃO TOTAL, HORÁRIO (mm)",
                         "PRECIPITACAO TOTAL", "PRECIPITAÇÃO TOTAL"],
    "temperature_c": ["TEMPERATURA DO AR - BULBO SECO, HORARIA (°C)",
                      "TEMPERATURA DO AR - BULBO SECO, HORÁRIA (°C)", "TEMPERATURA DO AR", "TEMPERATURA"],
    "humidity_pct": ["UMIDADE RELATIVA DO AR, HORARIA (%)", "UMIDADE RELATIVA DO AR, HORÁRIA (%)",
                     "UMIDADE RELATIVA", "UMIDADE"],
    "pressure_hpa": ["PRESSAO ATMOSFERICA AO NIVEL DA ESTACAO, HORARIA (mB)",
                     "PRESSÃO ATMOSFÉRICA AO NÍVEL DA ESTAÇÃO, HORÁRIA (mB)",
                     "PRESSAO ATMOSFERICA", "PRESSÃO ATMOSFÉRICA"],
    "wind_speed_ms": ["VENTO, VELOCIDADE HORARIA (m/s)", "VENTO, VELOCIDADE HORÁRIA (m/s)",
                      "VENTO VELOCIDADE", "VELOCIDADE VENTO"],
}
RAW_SEPARATOR = ";"
RAW_ENCODING = "ISO-8859-1"
ARCHIVE_YEARS = ["2020", "2021", "2022", "2023", "2024", "2025"]
ARCHIVE_FALLBACK = "temp"
MS_TO_KMH = 3.6

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: feature table
WINDOWS = (24, 48, 72)                      # rolling rain sums, rows
MA_WINDOWS = (6, 12, 24)                    # rolling means, full windows only
STD_WINDOWS = (12, 24)                      # rolling sample std, full windows only
DIFF_LAGS = (1, 6)
OUTLIER_LIMITS = [                          # column, low, high (inclusive)
    ("precipitation_mm", 0.0, 500.0),
    ("temperature_c", -10.0, 50.0),
    ("humidity_pct", 0.0, 100.0),
    ("nivel_metros", 0.0, 20.0),
]
NULL_SHARE_LIMIT = 0.3                      # drop a column with more than 30 % NULL
ID_COLUMNS = ["datetime", "location", "teve_enchente", "nivel_alerta"]
FINAL_COLUMNS = [
    "datetime", "location",
    "precipitation_mm", "temperature_c", "humidity_pct", "pressure_hpa",
    "wind_speed_kmh", "soil_moisture_pct", "nivel_metros", "taxa_subida_m_h",
    "hora", "dia_semana", "mes", "hora_sin", "hora_cos", "mes_sin", "mes_cos",
    "precip_24h", "precip_48h", "precip_72h",
    "precipitation_mm_ma_12h", "nivel_metros_ma_12h",
    "precipitation_mm_ma_24h", "nivel_metros_ma_24h",
    "precipitation_mm_std_12h", "nivel_metros_std_12h",
    "precipitation_mm_diff", "nivel_metros_diff",
    "aceleracao_nivel", "indice_saturacao", "risco_composto", "pressao_normalizada",
    "teve_enchente", "nivel_alerta",
]
RISK_WEIGHTS = [("precip_48h", 0.3), ("nivel_metros", 0.3), ("taxa_subida_m_h", 0.2), ("indice_saturacao", 0.2)]
SOIL_HUMIDITY_WEIGHT = 0.6
SOIL_RAIN_DIVISOR = 50.0
SOIL_RAIN_WEIGHT = 40.0
SOIL_LOW, SOIL_HIGH = 20.0, 95.0

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: interval labels
PRE_EVENT_HOURS = 72
DEFAULT_EVENT_DAYS = 3
ALERT_HOURS = (48, 24)      # > 48 h -> 1, > 24 h -> 2, otherwise 3

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: river level change from 48 h rain (band low limit, range low, range high)
RAIN_BANDS = [(150.0, 0.5, 1.5), (80.0, 0.2, 0.6), (30.0, 0.05, 0.25)]
RAIN_BAND_ELSE = (-0.15, 0.05)
SEASON_FACTORS = [((1, 2, 3, 4, 5), 1.8), ((6, 7, 8), 0.8), ((9, 10, 11), 1.2), ((12,), 1.4)]

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: device rules
RULE_P48_CRITICAL = 150.0
RULE_LEVEL_CRITICAL = 4.0
RULE_LEVEL_HIGH = 3.0
RULE_RISE_CRITICAL = 0.3
RULE_GATES = [            # column, gate (strictly above), divisor, weight
    ("precip_48h", 50.0, 150.0, 0.4),
    ("nivel_metros", 1.0, 4.0, 0.35),
    ("taxa_subida_m_h", 0.05, 0.3, 0.25),
]
RULE_THRESHOLD = 0.5
SCORE_PARTS = [           # column, divisor, weight
    ("precip_48h", 200.0, 0.4),
    ("nivel_metros", 5.0, 0.35),
    ("taxa_subida_m_h", 0.5, 0.25),
]
ALERT_CUTS = [(0.8, 3), (0.6, 2), (0.4, 1)]
ALERT_NAMES = ["VERDE", "AMARELO", "LARANJA", "VERMELHO"]
ALERT_DESCRIPTIONS = [
    "Normal - Monitoramento rotineiro",
    "Atenção - Acompanhar condições",
    "Alerta - Preparar ações preventivas",
    "Emergência - Evacuar área de risco",
]
VALID_RANGES = [("precip_48h", 0.0, 500.0), ("nivel_metros", 0.0, 10.0), ("taxa_subida_m_h", -1.0, 2.0)]
EMERGENCY_RAIN_CRITICAL = 50.0
EMERGENCY_RAIN_HIGH = 30.0
EMERGENCY_WEIGHTS = (0.4, 0.4, 0.2)   # level > 3, rain > 30, level > 4

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: decision modes (name, threshold) and level multipliers
MODES = [("emergencia", 0.05), ("urbano", 0.50), ("conservador", 0.80)]
MODE_LEVEL_FACTORS = [(1.5, 3), (1.2, 2), (1.0, 1)]
HIGH_PROBABILITY = 0.8

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: power management
BATTERY_FULL, BATTERY_GOOD, BATTERY_LOW, BATTERY_CRITICAL = 4.2, 3.8, 3.6, 3.3
SOLAR_CHARGING = 4.5
SOLAR_STRONG = 5.0
POWER_MODES = [           # mode, interval seconds, description
    ("NORMAL", 30, "Normal"),
    ("ECONOMY", 120, "Economia"),
    ("CRITICAL", 300, "Crítico"),
    ("EMERGENCY", 600, "Emergência"),
]
BATTERY_STATUS = [(4.2, "Cheia"), (3.8, "Boa"), (3.6, "Baixa"), (3.3, "Crítica")]
BATTERY_STATUS_ELSE = "Emergência"
HISTORY_SIZE = 48

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: sensor defaults and calibration
DEFAULT_TEMPERATURE = 25.0
DEFAULT_HUMIDITY = 60.0
DEFAULT_PRESSURE = 1013.25
PRESSURE_VALID = (800.0, 1200.0)
ADC_MAX = 4095
ADC_VREF = 3.3
BATTERY_DIVIDER = 2.0
SOLAR_DIVIDER = 3.0
SOUND_CM_PER_US = 0.034
SENSOR_HEIGHT_CM = 500.0
LEVEL_RANGE = (0.0, 10.0)
LEVEL_ON_TIMEOUT = 1.0

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: cold-start estimates (feature, source column, factor)
COLD_START = [
    ("precipitation_mm_ma_12h", "precipitation_mm", 0.8),
    ("nivel_metros_ma_12h", "nivel_metros", 0.95),
    ("precipitation_mm_ma_24h", "precipitation_mm", 0.6),
    ("nivel_metros_ma_24h", "nivel_metros", 0.9),
    ("precipitation_mm_std_12h", "precipitation_mm", 0.3),
    ("nivel_metros_std_12h", "nivel_metros", 0.1),
    ("precipitation_mm_diff", "precipitation_mm", 0.2),
    ("nivel_metros_diff", "nivel_metros", 0.05),
    ("aceleracao_nivel", "taxa_subida_m_h", 0.1),
]
PRESSURE_REFERENCE = 1013.25
PRESSURE_SCALE = 50.0

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: scenarios (name, rain x lo/hi, level + lo/hi, rise x lo/hi, humidity + lo/hi,
# pressure - lo/hi); all scenarios also wind x 1.5-3 and soil + 20-40
SCENARIOS = [
    ("leve", (2, 4), (0.5, 1.0), (5, 10), (10, 20), (5, 15)),
    ("moderada", (4, 8), (1.0, 2.0), (10, 20), (15, 25), (10, 25)),
    ("severa", (8, 15), (2.0, 3.5), (20, 40), (20, 35), (15, 35)),
    ("extrema", (15, 30), (3.5, 6.0), (40, 80), (25, 40), (25, 50)),
]
SCENARIO_WIND = (1.5, 3.0)
SCENARIO_SOIL = (20, 40)
SCENARIO_CLIPS = [("humidity_pct", 0.0, 100.0), ("soil_moisture_pct", 0.0, 100.0),
                  ("nivel_metros", 0.1, 15.0), ("taxa_subida_m_h", 0.0, 2.0)]
PROGRESS_STEPS = [(0, "leve"), (25, "leve"), (50, "moderada"), (75, "severa"), (90, "extrema")]

# ---------------------------------------------------------------------------------------------
# FIXED VALUES: thresholds and model selection
SWEEP_GRID_PCT = list(range(5, 95, 5))      # 0.05 ... 0.90
TUNE_GRID_PCT = list(range(10, 90, 5))      # 0.10 ... 0.85
DEFAULT_THRESHOLD = 0.5
SELECTION_WEIGHTS = {"precision": 0.3, "recall": 0.5, "f1": 0.2}
TUNING_WEIGHTS = {"recall": 0.6, "f1": 0.3, "precision": 0.1}
TEST_SHARE = 0.2
SEED = 42
SMOTE_K = 3
MIN_CLASS_ROWS = 10
IMBALANCE_WARN = 100
BALANCE_MIN_RATIO = 2.0
POS_WEIGHT_FALLBACK = 10.0
HIST_BINS = 30
