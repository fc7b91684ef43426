"""The small report tables that many tests share: five reports of four cases."""

DEMO = [
    ("1001", "10", "1", "20240105", "55", "F", "US", "1"),
    ("1002", "10", "2", "20240205", "56", "F", "US", "1"),
    ("2001", "20", "1", "20240305", "44", "M", "BR", "2"),
    ("3001", "30", "1", "20240320", "70", "F", "US", "1"),
    ("4001", "40", "1", "20240321", None, None, None, None),
]
DEMO_COLUMNS = "primaryid string, caseid string, caseversion string, fda_dt string, age string, sex string, occr_country string, serious string, quarter string"
DRUG = [
    ("1001", "10", "PS", "OLD PRODUCT", "OLD INGREDIENT"),
    ("1002", "10", "PS", "ASPIRIN PRODUCT", "ASPIRIN"),
    ("2001", "20", "SS", "ASPIRIN PRODUCT", "ASPIRIN"),
    ("2001", "20", "PS", "IBUPROFEN PRODUCT", "IBUPROFEN"),
    ("3001", "30", "PS", "ASPIRIN PRODUCT", "ASPIRIN"),
]
DRUG_COLUMNS = "primaryid string, caseid string, role_cod string, drugname string, prod_ai string"
REAC = [("1001", "10", "OLD EVENT"), ("1002", "10", "NAUSEA"), ("1002", "10", "NAUSEA"), ("1002", "10", "HEADACHE"), ("2001", "20", "NAUSEA"), ("3001", "30", "RASH")]
REAC_COLUMNS = "primaryid string, caseid string, pt string"
#: drug, role, event: a b c d, drug and event reports; source PROD_AI, universe 3
CELLS = {
    ("ASPIRIN", "all", "HEADACHE"): (1, 2, 0, 0, 3, 1),
    ("ASPIRIN", "all", "NAUSEA"): (2, 1, 0, 0, 3, 2),
    ("ASPIRIN", "all", "RASH"): (1, 2, 0, 0, 3, 1),
    ("ASPIRIN", "primary_suspect", "HEADACHE"): (1, 1, 0, 1, 2, 1),
    ("ASPIRIN", "primary_suspect", "NAUSEA"): (1, 1, 1, 0, 2, 2),
    ("ASPIRIN", "primary_suspect", "RASH"): (1, 1, 0, 1, 2, 1),
    ("ASPIRIN", "secondary_suspect", "NAUSEA"): (1, 0, 1, 1, 1, 2),
    ("ASPIRIN", "suspect", "HEADACHE"): (1, 2, 0, 0, 3, 1),
    ("ASPIRIN", "suspect", "NAUSEA"): (2, 1, 0, 0, 3, 2),
    ("ASPIRIN", "suspect", "RASH"): (1, 2, 0, 0, 3, 1),
    ("IBUPROFEN", "all", "NAUSEA"): (1, 0, 1, 1, 1, 2),
    ("IBUPROFEN", "primary_suspect", "NAUSEA"): (1, 0, 1, 1, 1, 2),
    ("IBUPROFEN", "suspect", "NAUSEA"): (1, 0, 1, 1, 1, 2),
}


def tables(spark):
    demo = spark.createDataFrame([(*r, "2024Q1") for r in DEMO], DEMO_COLUMNS)
    return demo, spark.createDataFrame(DRUG, DRUG_COLUMNS), spark.createDataFrame(REAC, REAC_COLUMNS)
