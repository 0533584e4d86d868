"""Fixed values of the daily weather data model.

Everything in this module is a fixed value: the codes, labels, ranges and
thresholds below must be exactly these for results to be comparable.
"""

# Measure codes of the daily point feed, in file order.
MEASURES = [
    "PRECTOTCORR", "QV2M", "RH2M", "T2M", "T2MDEW", "T2MWET", "T2M_MAX",
    "TS", "T2M_MIN", "ALLSKY_SFC_LW_DWN", "PS", "WS10M", "WD10M",
    "WS10M_MAX", "WS2M_MAX", "WS2M", "WD2M", "GWETPROF", "GWETTOP",
    "GWETROOT",
]

# Code -> Vietnamese column label.
COLUMN_LABELS = {
    "PRECTOTCORR": "Lượng mưa",
    "QV2M": "Độ ẩm tuyệt đối 2m",
    "RH2M": "Độ ẩm tương đối 2m",
    "T2M": "Nhiệt độ 2m",
    "T2MDEW": "Điểm sương 2m",
    "T2MWET": "Nhiệt độ bầu ướt 2m",
    "T2M_MAX": "Nhiệt độ tối đa 2m",
    "TS": "Nhiệt độ bề mặt đất",
    "T2M_MIN": "Nhiệt độ tối thiểu 2m",
    "ALLSKY_SFC_LW_DWN": "Bức xạ sóng dài xuống",
    "PS": "Áp suất bề mặt",
    "WS10M": "Tốc độ gió 10m",
    "WD10M": "Hướng gió 10m",
    "WS10M_MAX": "Tốc độ gió tối đa 10m",
    "WS2M_MAX": "Tốc độ gió tối đa 2m",
    "WS2M": "Tốc độ gió 2m",
    "WD2M": "Hướng gió 2m",
    "GWETPROF": "Độ ẩm đất mặt cắt",
    "GWETTOP": "Độ ẩm đất bề mặt",
    "GWETROOT": "Độ ẩm đất vùng rễ",
    "DATE": "Ngày",
    "LATITUDE": "Vĩ độ",
    "LONGITUDE": "Kinh độ",
}

TARGET_LABEL = COLUMN_LABELS["PRECTOTCORR"]
DATE_LABEL = COLUMN_LABELS["DATE"]
COORDINATE_LABELS = [COLUMN_LABELS["LATITUDE"], COLUMN_LABELS["LONGITUDE"]]
GROUP_LABEL = "Nhóm"

# Default range of the data set and the one default site.
DEFAULT_START = "20000101"
DEFAULT_END = "20250430"
DEFAULT_LATITUDE = 10.78
DEFAULT_LONGITUDE = 106.7
MAX_PAYLOAD_MEASURES = 20

# Fixed value: the feed writes this number where nothing was measured.
MISSING_SENTINEL = -999.0

# 24 h rain bands (key, lower bound, upper bound, labels).
# A band holds lo < x <= hi; the first one holds exactly x = 0.
RAIN_BANDS = [
    ("no_rain", 0.0, 0.0, "Không mưa", "No Rain"),
    ("trace_rain", 0.0, 0.6, "Mưa lượng không đáng kể", "Trace Rain"),
    ("light_rain", 0.6, 6.0, "Mưa nhỏ", "Light Rain"),
    ("moderate_rain", 6.0, 16.0, "Mưa", "Moderate Rain"),
    ("heavy_rain", 16.0, 50.0, "Mưa vừa", "Heavy Rain"),
    ("very_heavy_rain", 50.0, 100.0, "Mưa to", "Very Heavy Rain"),
    ("extremely_heavy_rain", 100.0, float("inf"), "Mưa rất to", "Extremely Heavy Rain"),
]

# Month -> season, and the months that count as wet.
SEASON_MONTHS = {
    "Dry": [12, 1, 2],
    "Pre-wet": [3, 4, 5],
    "Wet": [6, 7, 8],
    "Post-wet": [9, 10, 11],
}
WET_MONTHS = [5, 6, 7, 8, 9, 10, 11]

# A feature belongs to the first category one of whose terms
# its name contains.
FEATURE_TERMS = [
    ("Temperature", ["Nhiệt độ", "Điểm sương", "bầu ướt"]),
    ("Humidity", ["Độ ẩm"]),
    ("Wind", ["gió", "Hướng", "Tốc độ"]),
    ("Pressure_Radiation", ["Áp suất", "Bức xạ"]),
]

# Rain amounts that separate the four groups of the
# Kruskal-Wallis comparison (0 | (0, 2.5] | (2.5, 7.5] | > 7.5).
RAIN_GROUP_EDGES = [0.0, 2.5, 7.5]

RAIN_THRESHOLD = 0.1
