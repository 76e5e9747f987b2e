"""Fixed values the results depend on.

Everything in this module is a FIXED VALUE: the labels, cut points, word lists and
patterns below must stay exactly as written for results to agree with the
published analyses.  Operators take them as default parameters, so callers can
pass their own.
"""
from __future__ import annotations

# ---- FIXED VALUES: score columns --------------------------------------------------
# Emotion vector order; the order decides ties in arg-max over a profile.
EMOTIONS = ["anger", "disgust", "fear", "sadness", "joy", "optimism", "love", "trust",
            "anticipation", "pessimism", "surprise"]
SENTIMENTS = ["negative", "neutral", "positive"]
# Columns reported by the default mean battery, in report order.
ANGRY_THRESHOLD = 0.5

# ---- FIXED VALUES: categorical normalisation --------------------------------------
SENATE_SPELLINGS = ["Senate", "senator"]
HOUSE_SPELLINGS = ["House", "representative"]
CONGRESS_CHAMBERS = ["Senate", "House", "representative", "senator"]
STATE_ALIASES = {"MARIANA": "MP", "GUAM": "GU"}
DEFAULT_ZONE = "America/New_York"
EARLIEST_VALID_TS = "2006-03-21"

# Dominant IANA zone per state or territory (split-zone states use the most populous zone).
ZONE_STATES = {
    "America/New_York": "CT DE DC FL GA IN KY ME MD MA MI NH NJ NY NC OH PA RI SC VT VA WV PR VI",
    "America/Chicago": "AL AR IL IA KS LA MN MS MO NE ND OK SD TN TX WI",
    "America/Denver": "CO ID MT NM UT WY",
    "America/Phoenix": "AZ",
    "America/Los_Angeles": "CA NV OR WA",
    "America/Anchorage": "AK",
    "Pacific/Honolulu": "HI",
    "Pacific/Guam": "GU MP",
    "Pacific/Pago_Pago": "AS",
}
STATE_TZ = [(s, z) for z, states in ZONE_STATES.items() for s in states.split()]

# ---- FIXED VALUES: calendar buckets -----------------------------------------------
# month -> meteorological season (Northern Hemisphere)
SEASONS = [(12, "Winter"), (1, "Winter"), (2, "Winter"), (3, "Spring"), (4, "Spring"), (5, "Spring"),
           (6, "Summer"), (7, "Summer"), (8, "Summer")]
SEASON_ELSE = "Fall"
# hour bands, first match wins; anything else is the last label
HOUR_BANDS = [(9, 17, "09-17 work"), (18, 20, "18-20 evening"), (21, 23, "21-23 late"), (0, 4, "00-04 night")]
HOUR_BAND_ELSE = "05-08 morning"
NIGHT_BANDS = ["21-23 late", "00-04 night"]
DAY_BAND = "09-17 work"
# eras: label applies to timestamps before the cut (midnight UTC); the last label has no end
ERA_CUTS = [("2017-01-20", "Obama"), ("2021-01-20", "Trump"), ("2025-01-20", "Biden")]
ERA_LAST = "Trump II"
ERA_PARTY = ["D", "R", "D", "R"]
# generations by birth year (inclusive upper bounds)
GENERATION_CUTS = [(1945, "Silent"), (1964, "Boomer"), (1980, "Gen X"), (1996, "Millennial")]
GENERATION_LAST = "Gen Z"
AGE_BIN_YEARS = 5
AGE_RANGE = (25, 95)
DAYS_PER_YEAR = 365.25
DAYS_PER_CYCLE = 730.5

# ---- FIXED VALUES: result floors (full corpus / sample) ---------------------------
MIN_N_TIME = 300
MIN_N_FORECAST_CELL = 2000
MIN_N_NIGHT = 300
MIN_N_WEEK = 500
MIN_MEMBERS_FE = 20
MIN_EDGE = 3

# ---- FIXED VALUES: seismograph ----------------------------------------------------
TOP_SPIKES = 40
BASELINE_WEEKS = 13
BASELINE_MIN = 5
RESID_WEEKS = 52
RESID_MIN = 20
MIN_GAP_DAYS = 21
WINDOW_WEEKS_BEFORE = 6
WINDOW_WEEKS_AFTER = 7
MIN_TERM_COUNT = 15
TOP_WORDS = 10
TOP_TAGS = 5
DRIVER_MARGIN = 0.03
EXAMPLE_CHARS = 220

# Token pattern and stop list for distinctive terms.
TOKEN_PATTERN = r"#?[a-z][a-z'’\-]{2,}"
STOP_WORDS = """the a an and or of to in on for with is are was were be been this that these those it its at by from as we our
us you your they their he she his her i my me not no but if so than then there here who what when which will would can could
should has have had do does did just about into over more most all any some very out up down off also only new one two today
rt amp http https user via re s t m ve ll d don doesn didn isn aren won wouldn couldn shouldn get got make made like
""".split()

# ---- FIXED VALUES: registers ------------------------------------------------------
CIVIC = r"(bipartisan|across the aisle|both parties|both sides of the aisle|common ground|work(ing|ed)? together|come together|came together|\bunity\b|\bunite[ds]?\b|reach(ing|ed)? across)"
GRATITUDE = r"(thank you|thanks to|proud to|honored to|honoured to|grateful)"
DEM_OUT = r"(republican|\bgop\b|\bmaga\b|trump|mcconnell|speaker johnson|boehner|paul ryan|the right\b|far-right|extremist)"
REP_OUT = r"(democrat|\bdems?\b|\bdnc\b|biden|obama|pelosi|schumer|kamala|harris|the left\b|far-left|socialist|radical|liberal)"
POSITIVE_EMOTIONS = ["joy", "optimism", "love", "trust"]
NEGATIVE_EMOTIONS = ["anger", "disgust"]

# ---- FIXED VALUES: text patterns --------------------------------------------------
RETWEET_PREFIX = r"^RT @"
RETWEET_TARGET = r"^RT @(\w+)"
DOT_MENTION = r"(?:^|\s)\.@(\w+)"
LINK = r"https?://\S+"
DISPLAY_SUFFIX = r"\s+[DRI]-[A-Z]{2}$"
NAME_SUFFIX = r",?\s+(Jr|Sr|II|III|IV)\.?$"
TIDY_MAX = 220
TIDY_CUT = 217
EXEMPLAR_LEN = (70, 280)
EXEMPLAR_MIN_NO_LINK = 60

# ---- FIXED VALUES: networks -------------------------------------------------------
MAIN_GROUPS = ["Democrat", "Republican"]
EDGE_WEIGHTS = {"retweet": 1.0, "dot": 0.6}
EDGE_BUCKETS = [3, 6, 15, 50]
HUB_DOT_WEIGHT = 4
TOP_BRIDGES = 12
SPARSE_RETWEET_YEARS = [2023, 2024]

# ---- FIXED VALUES: forecast -------------------------------------------------------
VERDICT_CUTS = [(0.75, ">="), (0.5, ">="), (0.25, "<")]
VERDICT_TEXTS = ["it's an angry tweet.", "it's probably angry.", "it's probably not angry."]
VERDICT_ELSE = "it's a coin flip."
# how a lookup answer names what was known
MEMBER_FORMS = {"era": " during %s", "band": ", %s"}
CELL_FORMS = {"group": "a %s", "era": "during %s", "band": "at %s"}
NOTHING_KNOWN = "nothing known"
NO_DATA = "no data for that combination"
