"""Registered constants: fixed values that results depend on."""

EARTH_RADIUS_KM = 6371.0
KM_PER_DEGREE = 111.32
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
YEAR_DAYS = 365.25

ARCHIVE_EPOCH_YEAR, DEEP_EPOCH_YEAR = 1970, 1900
ARCHIVE_FLOOR, DEEP_FLOOR = 4.5, 7.5
PREFERRED_FLARE_CUTOVER_MS = 1_483_228_800_000  # 2017-01-01T00:00:00Z

DUPLICATE_SECONDS, DUPLICATE_MAGNITUDE, DUPLICATE_KM = 60, 0.5, 50.0
MECHANISM_SECONDS, MECHANISM_KM = 60, 100.0
ALERT_MAGNITUDE, ALERT_AGE_MINUTES = 5.8, 240
MISSED_MAGNITUDE, MISSED_LIMIT = 5.8, 10
EMPHASIS_MAGNITUDE = 5.5
RETENTION_KEEP_MAGNITUDE, RETENTION_HOURS = 4.5, 720
MIN_INTERVALS = 8

SEQUENCE_BINS_DAYS = [(0.0, 1.0), (1.0, 7.0), (7.0, 30.0), (30.0, 180.0), (180.0, None)]
ANTIPODE_RADIUS_KM, ANTIPODE_HOURS, ANTIPODE_FLOOR = 1000.0, 72, 5.0
DEPTH_BINS_KM = [0, 20, 70, 300, 500]

STORM_KP, STORM_DST, STREAM_WIND = 5.0, -100.0, 500.0  # display only

TARGET_MAGNITUDE = 5.0
BASELINE_DAYS = 365.25
ITERATIONS = 10_000
FALSE_DISCOVERY_RATE = 0.05
MATRIX_SIZE = 17
KS_BIN_KM, KS_BINS = 100.0, 201
TRIGGER_KP, TRIGGER_DST = 6.0, -100.0
LAGS = {"H4c": [(0, 24), (24, 48), (48, 72)], "H3b": [(0, 24), (24, 48), (48, 72), (72, 120)], "H2b": [(0, 24), (24, 48)], "H1b": [(0, 24), (24, 48), (48, 72), (72, 168)], "H5": [(0, 72)]}
SEEDS = {"H4c": 20260818, "H3b": 20260819, "H2b": 2026081901, "H1b": 2026081902, "H5": 2026082001}
STREAM_HOURS = 6
HEMISPHERE_DEGREES = 90.0
H5_TRIGGER_MAGNITUDE = 6.0
EFFECTIVE_START_YEAR = {"H4c": 1970, "H3b": 1995, "H2b": 2014, "H1b": 1996, "H5": 1970}
FLARE_CLASSES = "ABCMX"
