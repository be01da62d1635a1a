"""Controlled vocabularies, thresholds and word lists.

Fixed values: results depend on these exact values, so they are stated here as they are.
"""

THEMES = ("optical", "sar", "elevation", "water", "hydrography", "vegetation", "landcover", "builtup", "buildings",
          "population", "precipitation", "soil_moisture", "temperature", "boundaries", "transport", "events",
          "fire", "forest", "soil", "facilities", "surface_water")
PLANNERS = ("optical", "sar", "products")
KINDS = ("raster", "vector", "event")
SHAPES = ("layer", "series", "query", "events")
DRIVERS = ("stac", "http", "overpass", "gdacs")
TEMPORAL_MODES = ("static", "series", "pair")
PRIORITIES = ("required", "recommended", "optional")
LIVE_DRIVERS = ("overpass",)

MAX_ITEMS = 10_000
LARGE_AREA_KM2 = 50_000
SCENE_AREA_LIMIT_KM2 = 100_000
LONG_PERIOD_DAYS = 548
YEARLY_REVISIT_DAYS = 300
WINDOW_OVERHEAD_BYTES = 2_000_000
HAZARD_RADIUS_DEG = 3.0
REDUNDANT_TILE_SHARE = 0.01
CLOUD_MAX = 20.0
MIN_COVERAGE = 0.9
CLEAR_TARGET = 0.8
MEANING_MIN_SCORE = 0.325
MEANING_MARGIN = 0.06
MEANING_ADD_TO_KEYWORDS = 0.50
GB_FROM_BYTES = 5e7

TRANSIENT_ERRORS = ("429", "Too Many Requests", "500", "502", "503", "504", "Timeout", "timed out", "Connection",
                    "RemoteProtocolError", "CURL error")
OSM_TAGS = ("highway", "name", "building", "waterway", "surface", "lanes", "amenity", "healthcare", "operator:type")
PROTECTED_SUFFIXES = (".earthdatacloud.nasa.gov", ".earthdata.nasa.gov")
BLOB_SUFFIX = ".blob.core.windows.net"

VERDICTS = ("feasible-single", "feasible-composite", "infeasible", "incomplete", "out-of-range")

MONTH_NAMES = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october",
               "november", "december")
MONTH_WORDS = MONTH_NAMES + tuple(m[:3] for m in MONTH_NAMES if m != "may") + ("sept",)
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
                "ten": 10, "twelve": 12}
LEAD_WORDS = ("i", "we", "my", "our", "please", "help", "can", "could", "would", "show", "get", "give", "find", "fetch",
              "download", "map", "mapping", "assess", "analyse", "analyze", "analysis", "monitor", "monitoring", "detect",
              "study", "track", "estimate", "compute", "calculate", "compare", "need", "want", "what", "how", "where",
              "when", "which", "the", "a", "an", "in", "of", "for", "over", "is", "are", "was", "did", "flood", "floods",
              "drought", "urban", "slope", "road", "roads", "ndvi", "dem", "sar", "reservoir", "forest", "fire", "heat")
PREPOSITIONS = ("in", "near", "at", "around", "of", "over", "across", "for", "from", "within", "outside", "inside",
                "along", "to")
NAME_LINKS = ("of", "de", "la", "el", "al", "du", "do", "da")
ADMIN_WORDS = ("district", "taluk", "tehsil", "mandal", "block", "state", "province", "county", "city", "region",
               "division", "municipality", "village", "town", "basin", "watershed", "catchment")
END_WORDS = ("during", "since", "between", "from", "to", "and", "the", "last", "past", "this", "that", "in", "on", "at",
             "for", "with", "after", "before", "over", "by", "of", "when", "because", "due", "is", "was", "were", "are",
             "has", "have", "had", "please", "using", "per", "each", "every", "year", "years", "month", "months", "area",
             "region", "areas", "happened", "occurred", "help", "me", "analyse", "analyze", "locally")
LOWERCASE_PREPOSITIONS = ("in", "near", "at", "around", "over", "across", "of", "within", "for")

# Ellipsoid and projection constants (public geodetic values: WGS84, cylindrical equal area at 30 degrees).
WGS84_A = 6378137.0
WGS84_E = 0.0818191908426215
WGS84_F = 1 / 298.257223563
EQUAL_AREA_LAT = 30.0

# No-data extremes per pixel type; signed types use their minimum, unsigned their maximum, floats -9999.
DTYPE_NODATA = {"uint8": 255.0, "uint16": 65535.0, "uint32": 4294967295.0, "int8": -128.0, "int16": -32768.0,
                "int32": -2147483648.0, "float32": -9999.0, "float64": -9999.0}

# Sentences of verdicts, reasons and reports; outputs are compared as text. {} stands for a value.
SENTENCES = {
    "part imaged": "scenes in this window image only {} of the AOI",
    "tiles missing": " ({} of {} tiles had no acquisition)",
    "single is enough": "one scene per tile reaches {} expected clear coverage",
    "composite is needed": "single scenes give {} clear; a {}-scene composite reaches {}",
    "cloudy": "all {} scenes combined reach only {}% expected clear (target {}%); consider SAR, a longer window, or coarser daily optical",
    "clearest": "highest clear fraction {} of {} candidates",
    "too cloudy": "best available exceeds cloud threshold ({}% > {}%)",
    "swath edge": "footprint covers only {} of tile∩AOI (swath edge)",
    "no scene": "no acquisition intersects this tile in the window",
    "no product": "no product published for this window",
    "products": "{} product(s) cover {} of the AOI",
    "no pass": "no radar pass covers the AOI in this window",
    "pass": "orbit {} {} on {} covers {} of the AOI",
    "pass in part": " (partial)",
    "file unpublished": "file not published yet",
    "one file": "one file, clipped to the AOI",
    "area over limit": "AOI ({} km²) exceeds this query's limit ({} km²); use a smaller AOI",
    "live map query": "live OpenStreetMap query, clipped to the AOI",
    "downloaded": "downloaded and clipped to the AOI",
    "files meet": "{} file(s) intersect the AOI",
    "no tile meets": "no tile intersects the AOI",
    "theme": "theme '{}', {} data",
    "part of period": "covers only part of the period ({} → {})",
    "cloud-independent": "cloud-independent as preferred",
    "has login": "uses your NASA Earthdata token",
    "needs login": "needs a free NASA Earthdata token",
    "too large": "only scene-by-scene imagery ({}) provides this, and the area is too large for it (limit {} km²); name a smaller place",
    "login": "available from {} with a free NASA Earthdata token",
    "outside period": "{} is published only from {}, which does not overlap {}…{}; ask about a period within {}",
    "no source": "no registered source with theme '{}' for {} data over this area/period",
    "scenes too large": "{}: the area ({} km²) is too large for scene-by-scene imagery (limit {} km²); name a smaller place or use an area-wide product",
    "more windows": "… {} more windows (details in the plan file)",
    "uncovered": "no registered source has data for {}",
    "other form": "no {} source for this period; '{}' is supplied in another form above",
    "fallback": "  ↳ added automatically: {} is infeasible (cloud) for {}",
    "and more": " and {} more",
    "complement": "  ↳ added automatically: {} has no products for {}; this fills {}",
}
