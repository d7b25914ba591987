"""Domain lookup values.

FIXED VALUES: the tables between the markers must equal the values the
studied analysis uses (sector code map, name-pattern fills, regions, filing
tags and forms, the company-name normaliser word list, score weights, model
settings).  They are stated plainly, in their natural order.  The postal
abbreviation table is public reference data.
"""

from __future__ import annotations

# ---------------------------------------------------------------- FIXED VALUES
# NACE Rev.2 division (2-digit code) -> 35-sector code, in code order (87 codes).
NACE_TO_SECTOR = {
    "01": 1, "02": 1, "03": 1, "05": 2, "06": 2, "07": 2, "08": 2, "09": 2, "10": 3, "11": 3,
    "12": 3, "13": 4, "14": 4, "15": 5, "16": 6, "17": 7, "18": 7, "19": 8, "20": 9, "21": 9,
    "22": 10, "23": 11, "24": 12, "25": 12, "26": 14, "27": 14, "28": 13, "29": 15, "30": 15, "31": 16,
    "32": 16, "33": 16, "35": 17, "36": 17, "37": 17, "38": 17, "39": 17, "41": 18, "42": 18, "43": 18,
    "45": 19, "46": 20, "47": 21, "49": 23, "50": 24, "51": 25, "52": 26, "53": 26, "55": 22, "56": 22,
    "58": 27, "59": 27, "60": 27, "61": 27, "62": 30, "63": 30, "64": 28, "65": 28, "66": 28, "68": 29,
    "69": 30, "70": 30, "71": 30, "72": 30, "73": 30, "74": 30, "77": 30, "78": 30, "79": 26, "80": 30,
    "81": 30, "82": 30, "84": 31, "85": 32, "86": 33, "87": 33, "88": 33, "90": 34, "91": 34, "92": 34,
    "93": 34, "94": 34, "95": 34, "96": 34, "97": 35, "98": 35, "99": 34,
}

# Name-pattern fills applied when the sector code is null (substring match on
# the upper-cased company name; first rule first).
SECTOR_NAME_RULES = [
    (["APA", "COTERRA", "DEVON", "DIAMONDBACK", "EOG", "EXPAND ENERGY", "OCCIDENTAL",
      "PETROLEUM", "RESOURCES", "HALLIBURTON", "FREEPORT"], 2),
    (["MARTIN MARIETTA", "VULCAN"], 11),
]

# US regions by state name; every other value (Puerto Rico, provinces, null) -> Other.
US_REGIONS = {
    "Northeast": ["Maine", "New Hampshire", "Vermont", "Massachusetts", "Rhode Island",
                  "Connecticut", "New York", "New Jersey", "Pennsylvania"],
    "Midwest": ["Ohio", "Indiana", "Illinois", "Michigan", "Wisconsin", "Minnesota", "Iowa",
                "Missouri", "North Dakota", "South Dakota", "Nebraska", "Kansas"],
    "South": ["Delaware", "Maryland", "District of Columbia", "Virginia", "West Virginia",
              "North Carolina", "South Carolina", "Georgia", "Florida", "Kentucky", "Tennessee",
              "Mississippi", "Alabama", "Oklahoma", "Texas", "Arkansas", "Louisiana"],
    "West": ["Montana", "Idaho", "Wyoming", "Colorado", "New Mexico", "Arizona", "Utah",
             "Nevada", "Washington", "Oregon", "California", "Alaska", "Hawaii"],
}
OTHER_REGION = "Other"

# Postal abbreviation -> full name: 50 states, DC, PR and 13 Canadian provinces/territories.
STATE_ABBREVIATIONS = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee",
    "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
    "PR": "Puerto Rico", "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba",
    "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "NS": "Nova Scotia",
    "NT": "Northwest Territories", "NU": "Nunavut", "ON": "Ontario", "PE": "Prince Edward Island",
    "QC": "Quebec", "SK": "Saskatchewan", "YT": "Yukon",
}

# Filing variables -> tags in fallback order.
FILING_TAGS = {
    "assets": ["Assets"],
    "assets_current": ["AssetsCurrent"],
    "cash_and_equivalents": ["CashAndCashEquivalentsAtCarryingValue"],
    "liabilities_current": ["LiabilitiesCurrent"],
    "stockholders_equity": ["StockholdersEquity"],
    "revenue": ["RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues"],
    "operating_income_loss": ["OperatingIncomeLoss"],
    "net_income_loss": ["NetIncomeLoss"],
    "operating_cash_flow": ["NetCashProvidedByUsedInOperatingActivities"],
}
ANNUAL_FORMS = ["10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A"]
FILING_YEARS = (2013, 2025)
UNIT_PREFERENCE = ["USD", "USD/shares", "shares"]

# Company-name normaliser: "THE" stripped first, then the legal-form words;
# these characters become a blank: . , / ( ) ' (straight and curly) -
NAME_LEADING_WORDS = ["THE"]
NAME_LEGAL_WORDS = ["INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "COMPANIES",
                    "COS", "HOLDINGS", "HOLDING", "GROUP", "PLC", "LTD", "LIMITED", "N V", "NV",
                    "S A", "SA", "DE"]
NAME_PUNCTUATION = [".", ",", "/", "(", ")", "'", "’", "-"]
EXACT_MATCH_SCORE = 100
FUZZY_THRESHOLD = 92
OVERRIDE_SCORE = 999

# Upstreamness cutoff for the upstream/downstream cohorts.
UPSTREAM_CUTOFF = 1.9548
RECOVERY_HORIZONS = (1, 7, 30, 180)

# Outcome-stress score: base and weights over z-scores (deterministic part).
STRESS_BASE = 90.0
STRESS_WEIGHTS = {
    "damage": 10.0, "duration": 10.0, "net_debt": 7.0, "liquidity_ratio": -8.0,
    "cash": -7.0, "operating_cash_flow": -6.0, "ebitda_margin": -5.0, "net_income": -7.0,
    "pre_shock_price": -3.0, "inflation": 2.0, "gdp": -2.0, "region_ordinal": 2.0,
}
STRESS_INTERACTIONS = [("damage", "duration", 7.0), ("liquidity_ratio", "net_debt", -4.0)]
STRESS_CLAMP = (0.0, 365.0)
STRESS_TAILS = {"zero_share": 0.05, "long_share": 0.08, "cap": 180.0}

# Model settings.
RFE_SIZES = [5, 10, 15, 20, 25, 30]
N_SPLITS = 10
CV_FOLDS = 10
VIM_MIN = 0.75
P_MAX = 0.05
QUANTILE_LEVELS = [round(0.05 + 0.01 * i, 2) for i in range(96)]
# ------------------------------------------------------------- END FIXED VALUES

# Seed of the hash-based randomness (xxhash64(id, SEED)); R's generator cannot
# be reproduced by hashing, so this is our own choice, not a matched value.
SEED = 42


def nace_to_sector() -> dict[str, int]:
    """2-digit NACE string -> sector code (87 entries)."""
    return dict(NACE_TO_SECTOR)


def state_to_region() -> dict[str, str]:
    return {s: r for r, states in US_REGIONS.items() for s in states}
