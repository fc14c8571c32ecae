"""Declared schemas, column labels and code lists of the trial data model."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in columns.items()])


# Columns of the datasets, in order.
DM = _struct(
    STUDYID=_S, DOMAIN=_S, USUBJID=_S, SUBJID=_S, SITEID=_S, COUNTRY=_S, REGION=_S,
    AGE=_I, AGEGR1=_S, SEX=_S, RACE=_S, ETHNIC=_S, HEIGHTBL=_D, WEIGHTBL=_D, BMIBL=_D,
    DASCR=_D, DASGRP=_S, TRT01P=_S, TRT01PN=_I, ARM=_S, ACTARM=_S, RFSTDTC=_S, RFENDTC=_S,
    SAFFL=_S, ITTFL=_S, PPROTFL=_S, DMSEQ=_L,
)

AE = _struct(
    STUDYID=_S, DOMAIN=_S, USUBJID=_S, AESEQ=_I, AEDECOD=_S, AEBODSYS=_S, AESEV=_S, AESER=_S,
    AEREL=_S, AEOUT=_S, AESTDTC=_S, AEENDTC=_S, VISITNUM=_I, VISIT=_S,
)

EX = _struct(
    STUDYID=_S, DOMAIN=_S, USUBJID=_S, SITEID=_S, EXTRT=_S, EXDOSE=_I, EXDOSU=_S, EXROUTE=_S,
    EXOCCUR=_S, EXSTDTC=_S, EXENDTC=_S, VISITNUM=_I, VISIT=_S, EXSEQ=_I,
)

VS = _struct(
    STUDYID=_S, DOMAIN=_S, USUBJID=_S, VSTESTCD=_S, VSTEST=_S, VSORRESU=_S, VSSTRESN=_D,
    VSSTRESC=_S, VISITNUM=_I, VISIT=_S, VSDTC=_S, VSSEQ=_L,
)

DS = _struct(
    STUDYID=_S, DOMAIN=_S, USUBJID=_S, SITEID=_S, RFSTDTC=_S, RFENDTC=_S, DSCAT=_S, DSSCAT=_S,
    DSDECOD=_S, DSTERM=_S, DSSTDTC=_S, EOSSTT=_S, DPTFL=_S, DSSEQ=_I,
)

ADSL = _struct(
    STUDYID=_S, DATASET=_S, USUBJID=_S, SUBJID=_S, SITEID=_S, COUNTRY=_S, REGION=_S, AGE=_I,
    AGEGR1=_S, SEX=_S, SEXN=_I, RACE=_S, RACEN=_I, REGIONN=_I, ETHNIC=_S, HEIGHTBL=_D,
    WEIGHTBL=_D, BMIBL=_D, BMIGRP=_S, DAS28BL=_D, DAS28GRP=_S, TRT01P=_S, TRT01PN=_I, ARM=_S,
    ACTARM=_S, RFSTDTC=_S, RFENDTC=_S, SAFFL=_S, ITTFL=_S, PPROTFL=_S, DSDECOD=_S, EOSSTT=_S,
    DPTFL=_S, DCDT=_S, AENUM=_L, AESNUM=_L, AEMAXSEVN=_I, AEMAXSEV=_S, N_ALT_AE=_L,
    N_NEURO_GI_AE=_L, COMPLPCT=_D, N_MISSED_DOSES=_L, COMPLFL=_S, DAS28CHG=_D, ACR20FL=_S,
    DPTN=_I,
)

ADAE = _struct(
    STUDYID=_S, DATASET=_S, USUBJID=_S, SITEID=_S, TRT01P=_S, TRT01PN=_I, AGE=_I, SEX=_S,
    DPTFL=_S, AESEQ=_I, AEDECOD=_S, AEBODSYS=_S, AESEV=_S, AESEVN=_I, AESER=_S, AEREL=_S,
    AEOUT=_S, AESTDTC=_S, AEENDTC=_S, VISITNUM=_I, VISIT=_S, TRTEMFL=_S,
)

VALIDATION_LOG = _struct(
    CHECK_ID=_S, DOMAIN=_S, CHECK_NAME=_S, STATUS=_S, N_ISSUES=_L, DETAILS=_S
)

# Descriptions of the datasets.
DOMAIN_TEXT = {
    "DM": "Demographics",
    "AE": "Adverse Events",
    "EX": "Exposure",
    "VS": "Vital Signs",
    "DS": "Disposition",
    "ADSL": "Subject Level",
    "ADAE": "AE Analysis",
}

# Variables a demographics table must carry.
DM_REQUIRED = [
    "STUDYID", "DOMAIN", "USUBJID", "SUBJID", "SITEID", "AGE", "SEX", "RACE", "ETHNIC", "COUNTRY",
]

# Numeric codes of the analysis datasets.
SEX_CODE = {"F": 1}
SEX_CODE_OTHER = 2
RACE_CODE = {"WHITE": 1, "BLACK OR AFRICAN AMERICAN": 2, "ASIAN": 3}
RACE_CODE_OTHER = 4
REGION_CODE = {"Europe": 1, "AsiaPacific": 2}
REGION_CODE_OTHER = 0
SEVERITY_CODE = {"SEVERE": 3, "MODERATE": 2}
SEVERITY_CODE_OTHER = 1
SEVERITY_TEXT = {0: "NONE", 1: "MILD", 2: "MODERATE", 3: "SEVERE"}
SEVERITIES = ["MILD", "MODERATE", "SEVERE"]

# Fixed values: (sub-category, reported term, end-of-study status) by disposition term.
DISPOSITION = {
    "COMPLETED": ("STUDY COMPLETION", "Completed study as planned", "COMPLETED"),
    "ADVERSE EVENT": ("STUDY DRUG", "Discontinued due to adverse event", "DISCONTINUED"),
    "WITHDRAWAL BY SUBJECT": ("SUBJECT DECISION", "Subject withdrew consent", "DISCONTINUED"),
    "LOST TO FOLLOW-UP": ("OTHER", "Subject lost to follow-up", "DISCONTINUED"),
}
DISPOSITION_OTHER = ("OTHER", "Discontinued due to protocol deviation", "DISCONTINUED")

# Right-open bands (upper breaks, labels).
AGE_BANDS = ([40, 65], ["<40", "40-64", ">=65"])
DAS28_BANDS = ([3.2, 3.7, 5.1], ["Remission", "Low", "Moderate", "High"])
BMI_BANDS = ([18.5, 25.0, 30.0], ["Underweight", "Normal", "Overweight", "Obese"])

# Terms counted by the two special event counters.
ALT_TERMS = ["ALT Increased"]
NEURO_GI_TERMS = ["Headache", "Nausea", "Fatigue", "Dizziness", "Insomnia"]

# Study sites (site, country, region, planned subjects).
SITES = [
    ("101", "USA", "Americas", 40),
    ("102", "USA", "Americas", 35),
    ("103", "USA", "Americas", 38),
    ("104", "USA", "Americas", 37),
    ("105", "DEU", "Europe", 32),
    ("106", "DEU", "Europe", 30),
    ("107", "GBR", "Europe", 33),
    ("108", "JPN", "AsiaPacific", 35),
]

# Event terms (term, organ class, base probability, severe probability).
TERMS = [
    ("Headache", "Nervous_System_Disorders", 0.28, 0.04),
    ("Nausea", "Gastrointestinal_Disorders", 0.22, 0.03),
    ("Fatigue", "General_Disorders", 0.25, 0.06),
    ("Upper_Respiratory_Tract_Infection", "Infections_and_Infestations", 0.16, 0.02),
    ("Arthralgia", "Musculoskeletal_Disorders", 0.20, 0.07),
    ("Hypertension", "Vascular_Disorders", 0.13, 0.10),
    ("Rash", "Skin_and_Subcutaneous_Tissue_Disorders", 0.11, 0.08),
    ("Dizziness", "Nervous_System_Disorders", 0.13, 0.03),
    ("Insomnia", "Psychiatric_Disorders", 0.10, 0.02),
    ("ALT_Increased", "Investigations", 0.09, 0.12),
]

# Efficacy tests measured at each visit (code, name, unit, decimals).
VISIT_TESTS = [
    ("DAS28", "DAS28-CRP Disease Activity Score", "score", 1),
    ("TJC28", "Tender Joint Count (28 joints)", "count", 0),
    ("SJC28", "Swollen Joint Count (28 joints)", "count", 0),
]

# Model inputs, in order.
NUMERIC_FEATURES = [
    "AGE", "DAS28BL", "BMIBL", "COMPLPCT", "AENUM", "AESNUM", "AEMAXSEVN", "N_ALT_AE",
    "N_NEURO_GI_AE", "N_MISSED_DOSES",
]
CATEGORICAL_FEATURES = ["SEXN", "RACEN", "REGIONN", "TRT01PN"]
FEATURES = [
    "AGE", "SEXN", "RACEN", "REGIONN", "DAS28BL", "BMIBL", "TRT01PN", "AENUM", "AESNUM",
    "AEMAXSEVN", "N_ALT_AE", "N_NEURO_GI_AE", "COMPLPCT", "N_MISSED_DOSES",
]
FEATURE_LABELS = {
    "AGE": "Age (years)",
    "SEXN": "Sex (1=F, 2=M)",
    "RACEN": "Race (encoded)",
    "REGIONN": "Region (0=Americas, 1=Europe, 2=AsiaPac)",
    "DAS28BL": "DAS28 at Baseline",
    "BMIBL": "BMI at Baseline",
    "TRT01PN": "Treatment Arm (0=Placebo, 1=100mg, 2=200mg)",
    "AENUM": "Total AE Count",
    "AESNUM": "Serious AE Count",
    "AEMAXSEVN": "Max AE Severity (1=Mild, 2=Mod, 3=Sev)",
    "N_ALT_AE": "ALT Increased AEs",
    "N_NEURO_GI_AE": "Neuro/GI AE Count",
    "COMPLPCT": "Compliance (%)",
    "N_MISSED_DOSES": "Missed Doses",
}

# Scoring inputs (lowest, highest, whole numbers only, default when absent).
SCORE_RANGES = {
    "AGE": (18, 85, False, None),
    "SEXN": (1, 2, True, None),
    "RACEN": (1, 4, True, None),
    "REGIONN": (0, 2, True, None),
    "DAS28BL": (2, 9.4, False, None),
    "BMIBL": (16, 45, False, None),
    "TRT01PN": (0, 2, True, None),
    "AENUM": (0, 20, True, None),
    "AESNUM": (0, 10, True, None),
    "AEMAXSEVN": (0, 3, True, None),
    "N_ALT_AE": (0, 5, True, 0),
    "N_NEURO_GI_AE": (0, 8, True, 0),
    "COMPLPCT": (0, 100, False, None),
    "N_MISSED_DOSES": (0, 12, True, 0),
}

# Display labels of subject-level columns.
LABELS = {
    "STUDYID": "Study Identifier",
    "USUBJID": "Unique Subject Identifier",
    "AGE": "Age (years)",
    "SEX": "Sex",
    "SEXN": "Sex (N)",
    "RACE": "Race",
    "RACEN": "Race (N)",
    "REGIONN": "Region (N): 0=Americas, 1=Europe, 2=AsiaPac",
    "BMIBL": "BMI at Baseline (kg/m2)",
    "BMIGRP": "BMI Group",
    "DASCR": "DAS28 Score at Baseline",
    "DAS28BL": "DAS28 at Baseline",
    "TRT01P": "Planned Treatment for Period 01",
    "TRT01PN": "Planned Treatment for Period 01 (N)",
    "RFSTDTC": "Subject Reference Start Date/Time",
    "RFENDTC": "Subject Reference End Date/Time",
    "DSDECOD": "Standardized Disposition Term",
    "EOSSTT": "End of Study Status",
    "DPTFL": "Dropout Flag",
    "DPTN": "Dropout (1=Yes, 0=No)",
    "DCDT": "Discontinuation Date",
    "AENUM": "Total AE Count",
    "AESNUM": "Serious AE Count",
    "AEMAXSEVN": "Max AE Severity (N)",
    "AEMAXSEV": "Max AE Severity",
    "N_ALT_AE": "N ALT Increased AEs",
    "N_NEURO_GI_AE": "N Neuro/GI AEs",
    "COMPLPCT": "% Doses Taken (Compliance)",
    "N_MISSED_DOSES": "N Missed Doses",
    "COMPLFL": "Compliance Flag (>=80%)",
    "DAS28CHG": "DAS28 Change from Baseline",
    "ACR20FL": "ACR20 Response Flag",
    "AESEVN": "AE Severity (N)",
    "TRTEMFL": "Treatment-Emergent AE Flag",
}
