"""Fixed values of the care-home study: they must equal the study's own."""

# Admission dates that stand for "unknown" (upload dates).
EXCLUDED_INDEX_DATES = ["2016-04-04", "2016-07-25", "2016-08-22", "2015-11-02"]
INDEX_BEFORE = "2019-12-31"
COVID_CUT = "2019-03-20"
SERVICE_TYPES = ["Nursing", "Residential"]
MIN_AGE = 65
MIN_STAY_DAYS = 42

# Blood-pressure reading codes by kind, and the thresholds both of
# a person's two highest daily readings must exceed.
READING_CODES = {
    "diastolic": ["400975005", "163031004", "407557002", "407555005"],
    "systolic": ["163033001", "163030003", "163034007", "163035008", "407554009",
                 "407556006", "400974009", "163020007"],
    "home diastolic": ["413605002", "198000000000000", "314462001"],
    "home systolic": ["314449000", "413606001", "1.98E+14"],
}
READING_THRESHOLDS = {"diastolic": 90, "systolic": 140, "home systolic": 135, "home diastolic": 85}
READING_FLOOR = 10

# Plausible pressures, exclusive bounds (low, high).
PRE_RANGES = {"systolic": (79, 230), "diastolic": (49, None)}
POST_RANGES = {"systolic": (70, 250), "diastolic": (49, 200)}

# Drug classes by BNF paragraph; admitted code prefixes per window.
DRUG_CLASSES = {
    "calcium_channel_blocker": "0206020",
    "beta_blocker": "0204000",
    "thiazide_type_diuretic": "0202010",
    "angiotensin_receptor_blocker": "0205052",
    "ace_inhibitor": "0205051",
    "alpha_blocker": "0205040",
}
DRUG_PREFIXES = ["0206020", "0204000", "0202010", "020505", "0205040"]
DRUG_PREFIXES_AT_ADMISSION = ["0206020", "0204000", "020201", "020505", "020504"]

# Smoking labels and the code-list group each comes from.
SMOKING_GROUPS = {"ex-smoker": "Smoker (ex)", "current smoker": "Smoker (current)"}

# Cause-of-death patterns for cardiovascular death.
CV_CODE_PREFIX = "I"
CV_TEXT_1 = "irculat"
CV_TEXT_4 = "irculatory"

# ICD-10 prefixes of myocardial infarction.
MI_PREFIXES = ["I21", "I22"]
MI_THREE_CHAR = ["I21", "I22", "I23"]
MI_EXCLUDED_CODE = "I252"

# ICD-10 falls and fragility fractures.
FALL_CODES = [
    "W00", "W01", "W02", "W03", "W04", "W05", "W06", "W07", "W08", "W09",
    "W10", "W11", "W12", "W13", "W14", "W15", "W16", "W17", "W18", "W19",
    "M80", "S22", "S32", "S42", "S52", "S72", "S82", "T08", "T10", "T12", "T14.2",
]
# ICD-10 stroke.
STROKE_CODES = [
    "I60", "I600", "I601", "I602", "I603", "I604", "I605", "I606", "I607", "I608", "I609",
    "I61", "I610", "I611", "I612", "I613", "I614", "I615", "I616", "I618", "I619",
    "I62", "I620", "I621", "I629",
    "I63", "I630", "I631", "I632", "I633", "I634", "I635", "I636", "I638", "I639",
    "I64",
]

# Ethnicity texts that carry no information.
ETHNICITY_UNKNOWN = [
    "Ethnic category - 2011 census England and Wales",
    "O/E - ethnic group NOS",
    "O/E - ethnic group",
    "Ethnic groups (census) NOS",
    "Not specified - JDB",
]
# Ethnicity texts recoded when the person table says "Missing".
ETHNICITY_RECODE = {
    "White British": "White",
    "British or mixed British - ethnic category 2001 census": "White",
    "White: Irish - England and Wales ethnic category 2011 census": "White",
    "Other white ethnic group": "White",
    "Other White or White unspecified ethnic category 2001 census": "White",
    "White British - ethnic category 2001 census": "White",
    "Italian - ethnic category 2001 census": "White",
    "White Irish": "White",
}
ETHNICITY_COLLAPSE = {
    "Mixed/Multiple ethnic groups": "mixed/other ethnic groups",
    "Other ethnic group": "mixed/other ethnic groups",
}

# Frailty index break points of the two analyses and their labels.
FRAILTY_BREAKS = [0, 0.0857, 0.1624, 0.2392, 0.999]
FRAILTY_BREAKS_MORTALITY = [0, 0.12, 0.24, 0.36, 0.999]
FRAILTY_LABELS = ["fit", "mild frailty", "moderate frailty", "severe frailty"]
BMI_RANGE = (10, 70)

# Control target by age, months per unit, follow-up horizons.
TARGET_AGE, TARGET_OLD, TARGET_YOUNG = 80, 150, 140
DAYS_PER_MONTH = 30.44
EXPOSURE_DAYS = 365
CENSOR_DAYS = 730
NEAR_DEATH_DAYS = 60
EPISODE_GAP_DAYS = 30
TIME_POINTS = ["pre_admission", "admission", "post_admission"]
SURVIVAL_MONTHS = [0, 20, 40, 60, 80]
