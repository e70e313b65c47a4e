"""Names, codes, patterns and defaults the results depend on."""

# Corridor names (accented name in Unicode NFC).
TRANS_CARIOCA = "TransCarioca"
TRANS_OESTE = "TransOeste"
TRANS_OLIMPICA = "TransOlímpica"
NO_CORRIDOR = ""

# Chart order of the corridors.
CORRIDORS = (TRANS_CARIOCA, TRANS_OESTE, TRANS_OLIMPICA)

# First character of the line -> corridor.
CORRIDOR_OF_DIGIT = {
    "1": TRANS_OESTE,
    "2": TRANS_OESTE,
    "3": TRANS_CARIOCA,
    "4": TRANS_CARIOCA,
    "5": TRANS_OLIMPICA,
}

# Selector option that means "every corridor".
ALL_CORRIDORS = "Linha"

# LIKE patterns a fleet line code must match (any of them).
CODE_PATTERNS = ("5_____", "__A", "__")

# LIKE patterns a derived line must match (any of them).
LINE_PATTERNS = ("___", "__")

# Marker icons.
CORRIDOR_ICONS = {
    TRANS_CARIOCA: "../static/transcarioca.png",
    TRANS_OLIMPICA: "../static/transolimpica.png",
    TRANS_OESTE: "../static/transoeste.png",
}
STATION_ICON = "/static/estacao.png"

# Tag of the stacked vehicle-count series.
VEHICLE_STACK = "BusQuery"

# Lines of each corridor or lot; a line may be in two groups.
LINE_GROUPS = {
    "transoeste": ["10", "11", "12", "13", "14", "15", "17", "18", "19", "20", "20A", "21", "22", "23", "24"],
    "transcarioca": ["30", "31", "33", "35", "36", "38", "40", "41", "42"],
    "transolimpica": ["41", "50", "51", "53"],
    "lote_zero": ["18", "21", "22", "23", "24", "40", "50", "53"],
}

# The flat line list; it differs from the groups (21A, no 20A).
ALL_LINES = [
    "10", "11", "12", "13", "14", "15", "17", "18", "19", "20", "21", "21A", "22", "23", "24",
    "30", "31", "33", "35", "36", "38", "40", "41", "42",
    "41", "50", "51", "53",
    "18", "21", "22", "23", "24", "40", "50", "53",
]

# Stream and window defaults.
WATERMARK_DELAY = "10 minutes"
STREAM_WINDOW = "1 hour"
BATCH_WINDOW = "10 minutes"
MAX_FILES_PER_TRIGGER = 1000

# Look-back of the serving functions.
RECENT_MINUTES = 3
HEAT_MINUTES = 10
HOUR_VIEW_DAYS = 1
SPEED_VIEW_DAYS = 7
VEHICLE_VIEW_DAYS = 6

# Heat overlay settings and Web Mercator tile size / latitude clamp.
HEAT_RADIUS = 10
DEFAULT_RADIUS = 2
TILE_SIZE = 256
MAX_SIN_LAT = 0.9999
