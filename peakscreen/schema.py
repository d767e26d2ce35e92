"""Column names, vocabularies and rule maps of the instrument data model.

Everything here is a default: operators take these as parameters so that the
same code runs on other tables.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These must equal the lab's conventions for the results to
# match (instrument header names, name-cleaning literals, analyte vocabulary,
# sample-type rules, display names). Stated plainly, in their natural order.
# ---------------------------------------------------------------------------

SAMPLE_NAME = "Sample Name"
SAMPLE_TYPE = "Sample Type"
PEAK_NAME = "Analyte Peak Name"
PEAK_AREA = "Analyte Peak Area (counts)"
PEAK_HEIGHT = "Analyte Peak Height (cps)"
RT = "Analyte Retention Time (min)"
EXPECTED_RT = "Analyte Expected RT (min)"
CENTROID = "Analyte Centroid Location (min)"
START_SCAN = "Analyte Start Scan"
START_TIME = "Analyte Start Time (min)"
STOP_SCAN = "Analyte Stop Scan"
STOP_TIME = "Analyte Stop Time (min)"
PEAK_WIDTH = "Analyte Peak Width (min)"
AREA_RATIO = "Area Ratio"
HEIGHT_RATIO = "Height Ratio"
WIDTH_50 = "Analyte Peak Width at 50% Height (min)"
BASELINE_SLOPE = "Analyte Slope of Baseline (%/min)"
ASYMMETRY = "Analyte Peak Asymmetry"
INTEGRATION_QUALITY = "Analyte Integration Quality"
RRT = "Relative Retention Time"
ACQUISITION_DATE = "Acquisition Date"

# The 20 columns kept from the 81 of an export, in the lab's order.
PEAK_COLUMNS = [
    SAMPLE_NAME, SAMPLE_TYPE, PEAK_NAME,
    PEAK_AREA, PEAK_HEIGHT,
    RT, EXPECTED_RT,
    CENTROID, START_SCAN,
    START_TIME, STOP_SCAN,
    STOP_TIME, PEAK_WIDTH,
    AREA_RATIO, HEIGHT_RATIO,
    WIDTH_50,
    BASELINE_SLOPE, ASYMMETRY,
    INTEGRATION_QUALITY, RRT,
]

STRING_COLUMNS = [SAMPLE_NAME, SAMPLE_TYPE, PEAK_NAME]
# Columns that may hold spreadsheet error text such as "#DIV/0!"; they stay
# strings in the raw layer and are coerced in the feature layer.
DIRTY_COLUMNS = [AREA_RATIO, HEIGHT_RATIO, BASELINE_SLOPE]
NUMERIC_COLUMNS = [c for c in PEAK_COLUMNS if c not in STRING_COLUMNS + DIRTY_COLUMNS]

HEADER_PHRASE = "Sample Name"
UPLOAD_FIRST_LINE = "Peak Name: Myclobutanil d4"

SAMPLE_CODE_PATTERN = r"\d{8}-\d{2}"
REPLICATE_SUFFIX_LEN = 2
ANALYTE_REMOVE = ["-B1a", "-B1b", " NH4 Adduct", "cis-", "trans-"]
ANALYTE_MERGE = {"Spinosyn A": "Spinosad", "Spinosyn D": "Spinosad"}
REPORT_SPELLING = [("Imadacloprid_Result", "Imidacloprid_Result"),
                   ("Spirotretramat_Result", "Spirotetramat_Result")]
REPORT_SUFFIX = "_Result"

ANALYTES = ["Abamectin", "Azoxystrobin", "Bifenazate", "Etoxazole", "Imazalil",
            "Imidacloprid", "Malathion", "Myclobutanil", "Permethrin", "Spinosad",
            "Spiromesifen", "Spirotetramat", "Tebuconazole"]

# Sample type -> expected outcome (1 = should show a peak, 0 = should be clean).
EXPECTED_BY_TYPE = {"Quality Control": 1, "Standard": 1, "Blank": 0, "Solvent": 0}
UNKNOWN_TYPE = "Unknown"

# Features dropped by the "limited" feature set.
LIMITED_DROP = ["Analyte Start Scan", "Analyte Stop Scan",
                "Analyte Centroid Location (min)",
                "Relative Retention Time",
                "Analyte Integration Quality",
                "Analyte Peak Height (cps)",
                "Analyte Peak Width at 50% Height (min)",
                "height_ratio",
                "area_ratio",
                "Analyte Start Time (min)",
                "Analyte Stop Time (min)"]

# Display names for feature rankings (the misspelled start-scan key is kept as
# given, so that feature keeps its raw name).
DISPLAY_NAMES = {"Analyte Peak Area (counts)": "Peak Area",
                 "Analyte Peak Height (cps)": "Peak Height",
                 "area_ratio": "Area Ratio",
                 "height_ratio": "Height Ratio",
                 "Analyte Start Time (min)": "Start Time",
                 "Anlayte Start Scan": "Start Scan",
                 "Analyte Stop Time (min)": "Stop Time",
                 "Analyte Centroid Location (min)": "Centroid Location",
                 "Analyte Stop Scan": "Stop Scan",
                 "Analyte Integration Quality": "Integration Quality",
                 "Analyte Peak Width at 50% Height (min)": "Peak Width 50% Height",
                 "Analyte Peak Width (min)": "Peak Width",
                 "Analyte Peak Asymmetry": "Peak Assymetry",
                 "analyte_Azoxystrobin": "Azoxystrobin",
                 "analyte_Bifenazate": "Bifenazate",
                 "analyte_Etoxazole": "Etoxazole",
                 "analyte_Imazalil": "Imazalil",
                 "analyte_Imidacloprid": "Imidacloprid",
                 "analyte_Malathion": "Malathion",
                 "analyte_Myclobutanil": "Myclobutanil",
                 "analyte_Permethrin": "Permethrin",
                 "analyte_Spinosad": "Spinosad",
                 "analyte_Spiromesifen": "Spiromesifen",
                 "analyte_Spirotetramat": "Spirotetramat",
                 "analyte_Tebuconazole": "Tebuconazole",
                 "analyte_Abamectin": "Abamectin",
                 "rt_diff": "RT Difference",
                 "baseline": "Baseline Slope"}

# Tokens read as missing by a spreadsheet-style text parser ("#DIV/0!" is not
# one of them and is left for the numeric coercion).
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

# Acquisition timestamps, e.g. "5/6/2019 11:57:17 AM".
ACQUISITION_FORMAT = "M/d/yyyy h:mm:ss a"

# A strict decimal/scientific literal: what counts as a number in a dirty column.
NUMERIC_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# ---------------------------------------------------------------------------

REPORT_SCHEMA = T.StructType([
    T.StructField("SampleCode", T.StringType()),
    T.StructField("ComponentName", T.StringType()),
    T.StructField("Numeric Result", T.DoubleType()),
])


def peak_schema(with_file: bool = True) -> T.StructType:
    """Typed schema of the projected peak table (raw strings for dirty columns)."""
    fields = []
    if with_file:
        fields += [T.StructField("source_file", T.StringType(), False),
                   T.StructField("line_no", T.IntegerType(), False)]
    for c in PEAK_COLUMNS:
        dt = T.DoubleType() if c in NUMERIC_COLUMNS else T.StringType()
        fields.append(T.StructField(c, dt, True))
    return T.StructType(fields)
