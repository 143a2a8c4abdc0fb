from pyspark.sql import functions as F

from sigengine.functions.names import SYNONYMS, normalize_name

CASES = [
    (" aspirin 81 mg tablet", "ASPIRIN"),
    ("Tylenol", "ACETAMINOPHEN"),
    ("CO-TRIMOXAZOLE", "CO-TRIMOXAZOLE"),
    ("METFORMIN 500 MG EXTENDED RELEASE", "METFORMIN"),
    ("DRUG 5 MG/ML SOLUTION", "DRUG"),
    ("COUMADIN 2.5mg", "WARFARIN"),
    ("Lipitor", "ATORVASTATIN"),
    ("X 5% CREAM", "X 5"),
    ("VITAMIN B12 500 MCG", "VITAMIN B12"),
    ("A/B (R) oral drops", "A/B R"),
    ("\u00a0asa\u2003", "ASPIRIN"),
    ("***", None),
    ("", None),
    (None, None),
]


def test_names(spark):
    got = spark.createDataFrame(list(enumerate(x for x, _ in CASES)), "id int, name string").select("id", normalize_name(F.col("name")).alias("n")).orderBy("id").collect()
    assert [r.n for r in got] == [y for _, y in CASES]
    assert len(SYNONYMS) == 27
