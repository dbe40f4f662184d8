"""Fixed values.

Word lists, thresholds and formats that have to equal the published rule set for
results to agree.  They are stated as text, in their natural order; nothing here
is logic.  Larger tables (rebrand aliases, catalog aliases, provider dictionary)
are inputs, read as DataFrames.
"""

from __future__ import annotations

import re


def any_of(words: list[str]) -> str:
    """A regular expression that finds any of the words, taken literally."""
    return "|".join(re.escape(w) for w in words)


# ---- fixed values: reserved names (checked in this order) -------------------
NULL_NAMES = [
    "n/a",
    "na",
    "none",
    "null",
    "unknown",
    "not needed",
    "not applicable",
    "not required",
    "landlord",
    "included",
    "included in rent",
    "choose your electric here",
    "choose texas power",
    "power to choose",
    "select",
    "enter",
    "tbd",
    "pending",
]
PROPANE_NAMES = [
    "amerigas propane",
    "amerigas",
    "suburban propane",
    "direct propane",
    "superior plus propane",
    "superior propane",
    "mcphails",
    "ferrellgas",
    "ferrell gas",
]
HOLDING_NAMES = [
    "berkshire hathaway energy",
    "wec energy group",
    "southern company",
    "exelon",
    "nextera energy",
    "eversource energy",
    "entergy corporation",
    "firstenergy corp",
    "edison international",
    "sempra energy",
    "cms energy",
    "avangrid",
    "ppl corporation",
    "nisource",
    "agl resources",
    "scana",
]
# The dictionary build uses one more name than the matcher.
HOLDING_NAMES_DICTIONARY = [
    "berkshire hathaway energy",
    "wec energy group",
    "southern company",
    "exelon",
    "nextera energy",
    "eversource energy",
    "entergy corporation",
    "firstenergy corp",
    "edison international",
    "sempra energy",
    "cms energy",
    "alliant energy",
    "avangrid",
    "ppl corporation",
    "nisource",
    "agl resources",
    "scana",
]

# ---- fixed values: reported-value placeholders ------------------------------
TENANT_NULLS = [
    "",
    "n/a",
    "na",
    "none",
    "null",
    "unknown",
    "not applicable",
    "landlord",
    "included",
    "included in rent",
    "included in hoa",
    "hoa",
    "owner",
    "property",
    "management",
    "apt",
    "apartment",
    "complex",
    "community",
    "building",
    "self",
    "resident",
    "tenant",
    "renter",
    "occupant",
    "varies",
    "tbd",
    "pending",
    "see lease",
    "contact office",
    "ask management",
    "choose your electric here",
    "power to choose",
]
PROPANE_WORDS = [
    "amerigas",
    "suburban propane",
    "ferrellgas",
    "blue rhino",
    "propane",
    "tank",
    "bottled gas",
]

# ---- fixed values: Texas delivery utilities ---------------------------------
TDU_NAMES = [
    "ONCOR",
    "ONCOR ELECTRIC DELIVERY",
    "CENTERPOINT",
    "CENTERPOINT ENERGY",
    "AEP TEXAS",
    "AEP TEXAS CENTRAL",
    "AEP TEXAS NORTH",
    "TEXAS-NEW MEXICO POWER",
    "TNMP",
    "LUBBOCK POWER",
    "LUBBOCK P&L",
    "BLUEBONNET ELECTRIC",
    "BLUEBONNET ELEC",
]
TDU_PRIORITY = {
    "CENTERPOINT ENERGY": 1,
    "AEP TEXAS CENTRAL COMPANY": 2,
    "AEP TEXAS NORTH COMPANY": 2,
    "ONCOR ELECTRIC DELIVERY COMPANY LLC": 3,
    "TEXAS-NEW MEXICO POWER CO": 4,
    "CITY OF LUBBOCK - (TX)": 5,
}
ERCOT_TDUS = [
    "ONCOR ELECTRIC DELIVERY COMPANY LLC",
    "CENTERPOINT ENERGY",
    "AEP TEXAS CENTRAL COMPANY",
    "AEP TEXAS NORTH COMPANY",
    "TEXAS-NEW MEXICO POWER CO",
    "CITY OF LUBBOCK - (TX)",
]

# ---- fixed values: large investor-owned utilities and local utilities -------
LARGE_IOU_NAMES = [
    "DUKE ENERGY",
    "DUKE ENERGY CAROLINAS",
    "DUKE ENERGY PROGRESS",
    "DUKE ENERGY FLORIDA",
    "DUKE ENERGY INDIANA",
    "DUKE ENERGY OHIO",
    "DOMINION ENERGY",
    "DOMINION VIRGINIA POWER",
    "DOMINION ENERGY SOUTH CAROLINA",
    "AMERICAN ELECTRIC POWER",
    "AEP",
    "AEP OHIO",
    "AEP TEXAS",
    "APPALACHIAN POWER",
    "INDIANA MICHIGAN POWER",
    "KENTUCKY POWER",
    "SOUTHERN COMPANY",
    "GEORGIA POWER",
    "ALABAMA POWER",
    "MISSISSIPPI POWER",
    "ENTERGY",
    "ENTERGY ARKANSAS",
    "ENTERGY LOUISIANA",
    "ENTERGY MISSISSIPPI",
    "ENTERGY TEXAS",
    "NEXTERA ENERGY",
    "FLORIDA POWER & LIGHT",
    "FPL",
    "FLORIDA POWER AND LIGHT",
    "GULF POWER",
    "XCEL ENERGY",
    "NORTHERN STATES POWER",
    "PUBLIC SERVICE COMPANY OF COLORADO",
    "PACIFIC GAS & ELECTRIC",
    "PACIFIC GAS AND ELECTRIC",
    "PG&E",
    "CONSUMERS ENERGY",
    "EVERSOURCE",
    "EVERSOURCE ENERGY",
    "PPL ELECTRIC",
    "PPL CORPORATION",
    "LOUISVILLE GAS AND ELECTRIC",
    "KENTUCKY UTILITIES",
    "PACIFICORP",
    "ROCKY MOUNTAIN POWER",
    "PACIFIC POWER",
    "AMEREN",
    "AMEREN ILLINOIS",
    "AMEREN MISSOURI",
    "APS",
    "ARIZONA PUBLIC SERVICE",
    "IDAHO POWER",
    "TAMPA ELECTRIC",
    "TECO ENERGY",
]
LOCAL_WORDS = [
    "COOPERATIVE",
    "COOP",
    "ELECTRIC MEMBERSHIP",
    "ELECTRIC MEMBER",
    "MUNICIPAL",
    "CITY OF",
    "TOWN OF",
    "VILLAGE OF",
    "PUBLIC UTILITIES",
    "UTILITIES COMMISSION",
    "PUD",
    "PUBLIC UTILITY DISTRICT",
    "EMC",
    "CPW",
    "REA",
    "REC",
]
LOCAL_NAMES = [
    "ENERGY UNITED",
    "BRIGHTRIDGE",
    "JEA",
    "GREER CPW",
    "GREER COMMISSION OF PUBLIC WORKS",
    "SANTEE COOPER",
    "SECO ENERGY",
    "PEDERNALES ELECTRIC",
    "PEDERNALES ELECTRIC COOPERATIVE",
    "NEW BRAUNFELS UTILITIES",
    "BRYAN TEXAS UTILITIES",
    "CPS ENERGY",
    "AUSTIN ENERGY",
    "EPB",
    "EPB CHATTANOOGA",
    "GAINESVILLE REGIONAL UTILITIES",
    "KISSIMMEE UTILITY AUTHORITY",
    "TALQUIN ELECTRIC",
    "COWETA-FAYETTE EMC",
    "COWETA FAYETTE EMC",
    "CANOOCHEE EMC",
    "SNAPPING SHOALS EMC",
    "WAKE EMC",
    "PIEDMONT EMC",
    "PIEDMONT ELECTRIC MEMBERSHIP",
    "CENTRAL EMC",
    "CENTRAL ELECTRIC MEMBERSHIP",
    "LUMBEE RIVER EMC",
    "PEE DEE ELECTRIC",
    "BROAD RIVER ELECTRIC",
    "MID-CAROLINA ELECTRIC",
    "MID CAROLINA ELECTRIC",
    "NEWBERRY ELECTRIC",
]

# ---- fixed values: water -----------------------------------------------------
WATER_WORDS = [
    "WATER",
    "CITY OF",
    "TOWN OF",
    "VILLAGE OF",
    "COUNTY",
    "MUNICIPAL",
    "UTILITY",
    "UTILITIES",
    "DISTRICT",
    "MUD",
    "WSC",
    "SUD",
    "PUD",
    "WCID",
    "AUTHORITY",
    "COMMISSION",
    "DEPARTMENT",
    "DEPT",
    "SERVICE",
    "SUPPLY",
    "SYSTEM",
    "WORKS",
    "COOPERATIVE",
    "COOP",
    "CORP",
    "CORPORATION",
    "IMPROVEMENT",
    "SPECIAL",
    "RURAL",
]
WATER_GENERIC_WORDS = [
    "city",
    "of",
    "the",
    "water",
    "utilities",
    "utility",
    "department",
    "dept",
    "system",
    "public",
    "authority",
    "county",
    "town",
    "service",
    "services",
    "district",
    "plant",
    "filtration",
    "metropolitan",
    "regional",
    "board",
    "commission",
    "village",
    "municipal",
    "works",
]
WATER_ABBREVIATIONS = [
    (r"\bWtr\b", "Water"),
    (r"\bCo\b(?=\s|$)", "County"),
    (r"\bWs\b", "Water System"),
    (r"\bDept\b", "Department"),
    (r"\bAuth\b", "Authority"),
    (r"\bSvc\b", "Service"),
    (r"\bComm\b", "Commission"),
    (r"\bBd\b", "Board"),
    (r"\bKC\b", "Kansas City"),
    (r"\bFt\b", "Fort"),
    (r"\bSt\b(?=\s[A-Z])", "Saint"),
    (r"\bMt\b(?=\s)", "Mount"),
    (r"\bWsa\b", "Water and Sewer Authority"),
    (r"\bSud\b", "Special Utility District"),
    (r"\bWsc\b", "Water Supply Corporation"),
    (r"\bWcid\b", "Water Control and Improvement District"),
    (r"\bFwsd\b", "Fresh Water Supply District"),
    (r"\bPwsd\b", "Public Water Supply District"),
    (r"\bSd\b(?=\s*\d)", "Supply District"),
    (r"\bWtp\b", "Water Treatment Plant"),
]
WATER_GENERIC_SUFFIXES = [
    "Water Utilities Department",
    "Water Utility Department",
    "Water Department",
    "Water Utilities",
    "Water Utility",
    "Public Water System",
    "Water System",
    "Water Works",
    "Waterworks",
    "Water Dept",
    "Water Svc",
    "Water Service",
    "City Utilities",
    "Municipal Utilities",
    "Public Utilities",
    "Dept Of Public Utilities",
    "Department Of Public Utilities",
    "Pws",
]

# ---- fixed values: comparison ------------------------------------------------
CROSS_STATE_DENY = {
    "public service company of new mexico": ["NH", "VT", "MA", "CT", "ME"],
    "nicor gas": ["GA", "SC", "TN", "NC"],
}
GAS_ONLY_NAMES = ["intermountain gas"]
ELECTRIC_WORDS_IN_GAS = ["electric", " emc", "membership corp", "power company", "duke energy",
                         "rocky mountain power", "xcel energy"]
GA_GAS_DISTRIBUTORS = [
    "nicor gas",
    "atlanta gas light",
    "liberty utilities",
    "atmos energy",
]
GA_GAS_MARKETERS = [
    "georgia natural gas",
    "scana energy",
    "gas south",
    "constellation",
    "constellation energy",
    "infinite energy",
    "xoom energy",
    "xoom",
    "stream energy",
    "stream",
    "santanna energy",
    "volunteer energy",
    "true natural gas",
    "true gas",
    "walton emc natural gas",
    "snapping shoals emc natural gas",
    "sawnee emc",
    "fuel georgia",
]
CORE_STRIP_PATTERNS = [
    r"\s*-\s*\([a-z]{2}\)", r"\s*\([a-z]{2}\)",
    r"\bpud no \d+ of\b", r"\bcity of\b", r"\btown of\b",
    r"\binc\.?\b", r"\bcorp\.?\b", r"\bco\.?\b", r"\bllc\b",
    r"\belectric\b", r"\benergy\b", r"\bpower\b", r"\butilities\b",
    r"\bcooperative\b", r"\bcoop\b", r"\bmember\b", r"\bcorporation\b",
]
CATEGORIES = [
    "BOTH_EMPTY",
    "ENGINE_ONLY",
    "TENANT_ONLY",
    "TENANT_NULL",
    "TENANT_PROPANE",
    "MATCH",
    "MATCH_TDU",
    "MATCH_PARENT",
    "MATCH_ALT",
    "MISMATCH",
]
ID_BUCKETS = [
    "ID_MATCH",
    "ID_MATCH_TDU",
    "NAME_MATCH_ID_MISMATCH",
    "TRUE_MISMATCH",
    "TENANT_ID_MISSING",
    "ENGINE_ID_MISSING",
    "BOTH_ID_MISSING",
]
PARENT_GROUPS = {
    "Dominion Energy": [
        "Dominion Virginia Power",
        "Dominion Energy Virginia",
        "Dominion Energy",
        "Dominion NC",
        "Dominion Energy South Carolina",
        "Dominion Energy Ohio",
        "Questar Gas",
        "Virginia Natural Gas",
        "Dominion",
    ],
    "Duke Energy": [
        "Duke Energy",
        "Duke Energy Carolinas",
        "Duke Energy Progress",
        "Duke Energy Indiana",
        "Duke Energy Ohio",
        "Duke Energy Florida",
        "Piedmont Natural Gas",
        "Duke",
    ],
    "Southern Company": [
        "Georgia Power",
        "Alabama Power",
        "Mississippi Power",
        "Gulf Power",
        "Southern Company",
    ],
    "Eversource": [
        "Eversource",
        "Eversource CT",
        "Eversource MA",
        "Eversource NH",
        "NSTAR",
        "Yankee Gas",
        "Yankee Gas Service",
        "United Illuminating",
    ],
    "WEC Energy": [
        "We Energies",
        "Wisconsin Public Service",
        "Peoples Gas",
        "North Shore Gas",
        "WEC Energy",
    ],
    "Xcel Energy": [
        "Xcel Energy",
        "Northern States Power",
        "Public Service Company of Colorado",
        "Southwestern Public Service",
    ],
    "FirstEnergy": [
        "FirstEnergy",
        "Ohio Edison",
        "Cleveland Illuminating",
        "Cleveland Electric Illum",
        "Cleveland Electric Illuminating",
        "The Illuminating Company",
        "Illuminating Company",
        "Toledo Edison",
        "Mon Power",
        "Monongahela Power",
        "Potomac Edison",
        "West Penn Power",
        "West Penn Power Company",
        "Jersey Central P&L",
        "Met-Ed",
        "Penelec",
    ],
    "AEP": [
        "AEP",
        "AEP Ohio",
        "AEP Texas Central",
        "AEP Texas North",
        "AEP Texas",
        "Appalachian Power",
        "Indiana Michigan Power",
        "Kentucky Power",
        "Public Service Company of Oklahoma",
        "Southwestern Electric Power",
    ],
    "Exelon": [
        "Exelon",
        "ComEd",
        "Commonwealth Edison",
        "PECO",
        "PECO Energy",
        "BGE",
        "Baltimore Gas and Electric",
        "Pepco",
        "Potomac Electric Power",
        "Delmarva Power",
        "Atlantic City Electric",
    ],
    "PSE&G": [
        "PSE&G",
        "PSEG",
        "Public Service Electric and Gas",
        "Public Service Enterprise Group",
    ],
    "National Grid": [
        "National Grid",
        "National Grid MA",
        "KeySpan",
        "New England Power",
    ],
    "Entergy": [
        "Entergy",
        "Entergy Arkansas",
        "Entergy Louisiana",
        "Entergy Mississippi",
        "Entergy New Orleans",
        "Entergy Texas",
    ],
    "Sempra": [
        "SDG&E",
        "San Diego Gas & Electric",
        "SoCalGas",
        "Southern California Gas",
    ],
    "PG&E": [
        "PG&E",
        "Pacific Gas and Electric",
        "Pacific Gas & Electric",
    ],
    "Con Edison": [
        "Con Edison",
        "ConEd",
        "Consolidated Edison",
        "Orange and Rockland",
        "O&R",
    ],
    "Alliant Energy": [
        "Alliant Energy",
        "Wisconsin Power & Light",
        "Wisconsin Power And Light",
        "Interstate Power and Light",
        "IPL",
    ],
    "Enbridge": [
        "Enbridge Gas",
        "Enbridge Gas Ohio",
        "Enbridge Gas North Carolina",
        "Enbridge Gas NC",
        "Public Service NC",
        "Public Service Company of North Carolina",
        "PSNC Energy",
        "Vectren Energy",
        "Vectren",
    ],
    "Gas South": [
        "Gas South",
        "Gas South Avalon",
        "Nicor Gas",
    ],
    "Hawaiian Electric": [
        "Hawaiian Electric",
        "Hawaiian Electric Company",
        "Hawaii Electric Light",
        "Hawaii Electric Light Company",
        "HELCO",
        "Maui Electric",
        "MECO",
    ],
    "Seattle Utilities": [
        "Seattle City Light",
        "Seattle Public Utilities",
    ],
    "Dominion Energy Utah": [
        "Dominion Energy",
        "Dominion Energy Utah",
        "Questar Gas",
    ],
    "Columbia Gas": [
        "Columbia Gas",
        "Columbia Gas VA",
        "Columbia Gas of Virginia",
        "Columbia Gas of Pennsylvania",
        "Columbia Gas of Ohio",
        "Columbia Gas of Maryland",
    ],
}

# ---- fixed values: names -----------------------------------------------------
LEGAL_SUFFIXES = [", INC.", ", INC", " INC.", " INC", ", CORP.", ", CORP", " CORP.", " CORP",
                  ", LLC", " LLC", ", L.L.C.", " L.L.C.", ", L.P.", " L.P.",
                  " COMPANY", " CO.", " CO"]
DISPLAY_SUFFIXES = [", Inc.", ", Inc", " Inc.", " Inc", ", Corp.", ", Corp", " Corp.", " Corp",
                    ", LLC", " LLC", ", L.L.C.", " Company", " Co.", ", L.P.", " L.P."]
STATE_CODES = [
    "AL",
    "AK",
    "AZ",
    "AR",
    "CA",
    "CO",
    "CT",
    "DE",
    "FL",
    "GA",
    "HI",
    "ID",
    "IL",
    "IN",
    "IA",
    "KS",
    "KY",
    "LA",
    "ME",
    "MD",
    "MA",
    "MI",
    "MN",
    "MS",
    "MO",
    "MT",
    "NE",
    "NV",
    "NH",
    "NJ",
    "NM",
    "NY",
    "NC",
    "ND",
    "OH",
    "OK",
    "OR",
    "PA",
    "RI",
    "SC",
    "SD",
    "TN",
    "TX",
    "UT",
    "VT",
    "VA",
    "WA",
    "WV",
    "WI",
    "WY",
    "DC",
]
EIA_STOP_WORDS = [
    "ELECTRIC",
    "POWER",
    "ENERGY",
    "COMPANY",
    "CORPORATION",
    "CORP",
    "INC",
    "LLC",
    "CO",
    "OF",
    "THE",
    "AND",
    "UTILITY",
    "UTILITIES",
    "SERVICE",
    "SERVICES",
    "LIGHT",
    "GAS",
    "COOPERATIVE",
    "COOP",
    "ASSOCIATION",
    "AUTHORITY",
    "DEPARTMENT",
    "DEPT",
    "COMMISSION",
    "BOARD",
    "DISTRICT",
    "MUNICIPAL",
    "CITY",
    "COUNTY",
    "STATE",
    "PUBLIC",
    "RURAL",
]
WHOLESALE_WORDS = [
    "bonneville power",
    "western area power",
    "tennessee valley authority",
    "southwestern power admin",
    "southeastern power admin",
    "power marketing",
    "generation",
    "transmission",
]
CASING = {
    "pg&e": "PG&E", "pge": "PG&E", "sce": "SCE", "sdg&e": "SDG&E", "sdge": "SDG&E",
    "socalgas": "SoCalGas", "comed": "ComEd", "cps energy": "CPS Energy", "aep": "AEP",
    "aep texas": "AEP Texas", "aep ohio": "AEP Ohio", "dte": "DTE", "dte energy": "DTE Energy",
    "pse&g": "PSE&G", "pseg": "PSE&G", "bge": "BGE", "bg&e": "BGE", "og&e": "OG&E", "oge": "OG&E",
    "lg&e": "LG&E", "lge": "LG&E", "fpl": "FPL", "ouc": "OUC", "jea": "JEA", "smud": "SMUD",
    "ladwp": "LADWP", "srp": "SRP", "aps": "APS", "tep": "TEP", "peco": "PECO", "ppl": "PPL",
    "ppl electric": "PPL Electric", "nipsco": "NIPSCO", "ipl": "IPL", "teco": "TECO Energy",
    "teco energy": "TECO Energy", "tnmp": "TNMP", "pnm": "PNM", "mdu": "MDU", "mud": "MUD",
    "we energies": "WE Energies", "con edison": "Con Edison", "coned": "Con Edison",
    "nyseg": "NYSEG", "rg&e": "RG&E", "pepco": "PEPCO", "pgw": "PGW", "ugi": "UGI",
    "met-ed": "Met-Ed", "psc colorado": "PSC of Colorado", "nv energy": "NV Energy",
    "lg&e/ku": "LG&E/KU", "centerpoint energy": "CenterPoint Energy",
    "centerpoint": "CenterPoint Energy", "xcel energy": "Xcel Energy",
    "xcel energy colorado": "Xcel Energy Colorado", "xcel energy minnesota": "Xcel Energy Minnesota",
    "midamerican energy": "MidAmerican Energy", "pacificorp": "PacifiCorp", "con ed": "Con Edison",
}

# ---- fixed values: addresses and geocoding ----------------------------------
ADDRESS_ABBREVIATIONS = [
    ("street", "st"), ("avenue", "ave"), ("boulevard", "blvd"), ("drive", "dr"), ("road", "rd"),
    ("lane", "ln"), ("court", "ct"), ("place", "pl"), ("apartment", "apt"), ("suite", "ste"),
    ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"),
]
LOCATION_TYPE_SCORE = {"ROOFTOP": 0.98, "RANGE_INTERPOLATED": 0.90, "GEOMETRIC_CENTER": 0.80,
                       "APPROXIMATE": 0.60}
LOCATION_TYPE_DEFAULT = 0.70

# ---- fixed values: broadband -------------------------------------------------
TECH_LABELS = {"10": "DSL", "40": "Cable", "50": "Fiber", "60": "Satellite (GSO)",
               "61": "Satellite (NGSO)", "70": "Fixed Wireless (Licensed)",
               "71": "Fixed Wireless (Unlicensed)", "72": "Fixed Wireless (CBRS)", "0": "Other"}
TECH_ORDER = ["50", "40", "10", "70", "72", "71", "60", "61", "0"]

# ---- fixed values: catalog ---------------------------------------------------
CATALOG_TYPE_IDS = {"electric": "2", "gas": "4", "water": "3", "sewer": "6", "trash": "5",
                    "internet": "8"}
CATALOG_TYPES_KEPT = ["2", "3", "4", "5", "6", "7", "8"]
CATALOG_ABBREVIATIONS = {
    "sce": "southern california edison", "socalgaz": "southern california gas",
    "socalgas": "southern california gas", "sdg&e": "san diego gas electric",
    "sdge": "san diego gas electric", "pg&e": "pg e", "pge": "pg e", "pse&g": "pse g",
    "pseg": "pse g", "cemc": "cumberland electric membership", "comed": "comed",
    "lge": "louisville gas electric", "lg&e": "louisville gas electric",
    "bge": "baltimore gas electric", "dte": "dte energy", "aps": "arizona public service",
    "tep": "tucson electric power", "nstar": "eversource", "rge": "rochester gas electric",
    "rg&e": "rochester gas electric", "nyseg": "new york state electric gas",
    "jcp&l": "jersey central power light", "jcpl": "jersey central power light",
    "pepco": "potomac electric power", "eastohiogas": "enbridge gas ohio",
    "eastohiogascodominion": "enbridge gas ohio", "dominioneastohio": "enbridge gas ohio",
    "sceg": "dominion energy south carolina", "sce&g": "dominion energy south carolina",
    "srp": "salt river project", "ladwp": "los angeles department of water power",
    "tnmp": "texas new mexico power", "lge ku": "louisville gas electric",
    "lgeku": "louisville gas electric", "lg&e/ku": "louisville gas electric",
    "chelco": "choctawhatchee electric cooperative",
}
# (all of these words, then at least one of these or none) -> replacement title; in order.
CATALOG_TITLE_RULES = [
    (["jones", "onslow"], ["emc", "electric"], "jones onslow electric membership"),
    (["intermountain gas"], [], "intermountain gas"),
    ([], ["upper cumberland e m c", "upper cumberland emc"], "upper cumberland electric membership"),
    (["wisconsin rapids waterworks"], [], "wisconsin rapids water works lighting commission"),
    (["philadelphia water"], [], "city of philadelphia"),
    (["citizens water", "indianapolis"], [], "citizens energy"),
    (["fort wayne", "3 rivers"], [], "fort wayne city utilities"),
    (["pittsburgh", "w and s"], [], "pittsburgh water sewer authority"),
    (["pittsburgh", "water", "sewer"], [], "pittsburgh water sewer authority"),
    (["sarasota", "special"], [], "sarasota county water"),
    (["augusta", "richmond"], [], "augusta utility"),
    (["north las vegas"], ["util", "water"], "city of north las vegas"),
    ([], ["cal am water", "cal american water"], "california american water"),
    (["acsa", "urban"], [], "albemarle county service authority"),
    (["okaloosa"], ["wtr", "water"], "okaloosa county water sewer"),
    (["global water", "santa cruz"], [], "global water resources"),
    (["west view"], ["muni", "auth"], "west view water authority"),
    (["saws"], [], "san antonio water system"),
    (["charles county", "dpw"], [], "charles county department of public works"),
    (["greer cpw"], [], "greer commission of public works"),
    (["greer", "commission"], [], "greer commission of public works"),
    (["pwcsa"], [], "prince william water"),
    (["coachella"], ["vwd", "valley"], "coachella valley water district"),
    (["elsinore"], ["mwd", "valley"], "elsinore valley municipal water district"),
    (["skagit"], ["pud", "county"], "skagit public utility district"),
    (["goforth", "sud"], [], "goforth special utility district"),
    (["consolidated mutual"], [], "consolidated mutual water"),
    (["smyrna", "natural gas"], [], "smyrna utilities department"),
    (["rio grande valley gas"], [], "rio grande valley gas"),
]
CATALOG_TITLE_RULES_LATE = [
    (["charlotte", "mecklenburg"], [], "charlotte water"),
    (["winston", "salem"], ["water", "city"], "city of winston salem"),
    (["chaparral city water"], [], "epcor water arizona"),
    ([], ["az water co", "arizona water co"], "epcor water arizona"),
]
AMERICAN_WATER_STATES = {
    "mo ": "missouri ", "pa ": "pennsylvania ", "in ": "indiana ", "wv ": "west virginia ",
    "tn ": "tennessee ", "il ": "illinois ", "ia ": "iowa ", "nj ": "new jersey ",
    "va ": "virginia ", "ca ": "california ", "ky ": "kentucky ", "md ": "maryland ",
}
CATALOG_LEGAL_SUFFIXES = [" corporation", " corp", " inc", " llc", " co-op", " co op", " company",
                          " electric delivery"]

# ---- fixed values: contacts --------------------------------------------------
CONTACT_SUFFIXES = {
    "electric": ["Electric", "Electric-", "Power"],
    "gas": ["Gas", "Energy"],
    "water": ["Water", "Water Utility", "Water Utilities"],
    "sewer": ["Sewer", "Wastewater"],
}

# ---- fixed values: retail provider extraction (Texas) -----------------------
NOT_RETAIL = [
    "oncor",
    "oncor electric-tx",
    "oncor electric delivery",
    "oncor electric delivery company",
    "oncor electric delivery company llc",
    "centerpoint energy",
    "centerpoint energy - tx",
    "centerpoint energy houston electric",
    "aep texas",
    "aep texas central",
    "aep texas north",
    "aep texas inc.",
    "texas-new mexico power",
    "texas-new mexico power company",
    "tnmp",
    "lubbock power & light",
    "lubbock power & light system",
    "lubbock power & light - tx",
    "entergy texas",
    "entergy texas, inc.",
    "entergy",
    "el paso electric",
    "el paso electric company",
    "southwestern electric power company",
    "southwestern electric power company - ar",
    "swepco",
    "xcel energy",
    "xcel energy colorado",
    "xcel energy minnesota",
    "aep energy",
    "austin energy",
    "cps energy",
    "bryan texas utilities",
    "san marcos texas utilities",
    "college station utilities",
    "georgetown utility systems",
    "garland power & light",
    "new braunfels utilities",
    "brownsville public utilities board - tx",
    "floresville electric light & power system (felps)",
    "geus (greenville electric utility system)",
    "kerrville public utility board",
    "seguin electric division",
    "boerne utilities",
    "brenham",
    "denton municipal electric",
    "city of lubbock",
    "city of brownsville",
    "pedernales electric cooperative",
    "pedernales electric",
    "pedernales",
    "pec",
    "bluebonnet electric",
    "coserv",
    "coserv electric cooperative, inc.",
    "gvec",
    "guadalupe valley electric cooperative, inc.",
    "hilco electric cooperative, inc.",
    "magic valley electric cooperative, inc.",
    "sam houston electric cooperative, inc.",
    "south plains electric co",
    "south plains electric cooperative, inc.",
    "south plains electric cooperative - tx",
    "tri-county electric cooperative, inc.",
    "trinity valley electric cooperative, inc.",
    "trinity valley electric",
    "united electric cooperative services, inc.",
    "grayson-collin electric cooperative, inc.",
    "deep east texas electric cooperative, inc.",
    "mid-south electric cooperative association",
    "bandera electric cooperative, inc.",
    "bartlett electric cooperative, inc.",
    "farmers electric cooperative, inc.",
    "choose your electric here",
    "choose texas power",
    "power to choose",
    "tx)",
    "tx",
    "inc - (tx)",
    "spring",
    "inc.",
    "inc",
    "green mountain power - vt",
    "green mountain power",
    "peco electric",
    "atmos energy",
    "atmos energy - tx",
    "centerpoint energy gas",
]
NOT_RETAIL_WORDS = ["cooperative", "co-op", "coop", "municipal", "city of", "choose", "county"]

# ---- fixed values: review ----------------------------------------------------
REVIEW_COLUMNS = [
    "Address", "State", "ZIP", "Utility Type", "Engine Provider", "Engine Provider ID",
    "Engine Confidence", "Engine Source", "ID Match Score", "ID Confident", "Tenant Provider",
    "Tenant Provider ID", "Match Status", "Alternatives (with IDs)", "Review Reason",
    "Mapper Decision", "Mapper Corrected Provider", "Mapper Corrected ID", "Mapper Notes",
]
PROTECTED_SOURCE_WORDS = ["eia_zip", "eia_id", "hifld", "state_gis", "epa"]
