"""Clean-up of free-text drug names by native expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Brand and other names, and the generic names they stand for. Callers may pass a larger table.
SYNONYMS = {
    "ASA": "ASPIRIN",
    "ACETYLSALICYLIC ACID": "ASPIRIN",
    "TYLENOL": "ACETAMINOPHEN",
    "PARACETAMOL": "ACETAMINOPHEN",
    "ADVIL": "IBUPROFEN",
    "MOTRIN": "IBUPROFEN",
    "ALEVE": "NAPROXEN",
    "VIOXX": "ROFECOXIB",
    "BEXTRA": "VALDECOXIB",
    "LIPITOR": "ATORVASTATIN",
    "ZOCOR": "SIMVASTATIN",
    "PLAVIX": "CLOPIDOGREL",
    "WARFARIN SODIUM": "WARFARIN",
    "COUMADIN": "WARFARIN",
    "XARELTO": "RIVAROXABAN",
    "ELIQUIS": "APIXABAN",
    "PRADAXA": "DABIGATRAN",
    "XELJANZ": "TOFACITINIB",
    "RINVOQ": "UPADACITINIB",
    "OLUMIANT": "BARICITINIB",
    "OZEMPIC": "SEMAGLUTIDE",
    "WEGOVY": "SEMAGLUTIDE",
    "MOUNJARO": "TIRZEPATIDE",
    "TRULICITY": "DULAGLUTIDE",
    "PROZAC": "FLUOXETINE",
    "ZOLOFT": "SERTRALINE",
    "PAXIL": "PAROXETINE",
}
#: Fixed patterns: a dose, or a way of taking the drug, ends the name together with all that follows on its line.
DOSE = r"(?idU)\s*\d+(\.\d+)?\s*(MG|MCG|MG/ML|MG/KG|ML|G|IU|UNIT|%|MG/L)\b.*$"
ROUTE = r"(?idU)\s+(TABLET|CAPSULE|INJECTION|ORAL|IV|TOPICAL|CREAM|GEL|SYRUP|PATCH|PILL)\b.*$"
OTHER = r"[^A-Z0-9 \-/]"


def normalize_name(name: Column, synonyms: dict[str, str] | None = None) -> Column:
    """The generic name in capitals; null where nothing is left."""
    table = SYNONYMS if synonyms is None else synonyms
    x = F.upper(F.regexp_replace(F.regexp_replace(name, r"(?U)^\s+", ""), r"(?U)\s+$", ""))
    x = F.regexp_replace(F.regexp_replace(x, DOSE, ""), ROUTE, "")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, OTHER, " "), r"\s+", " "))
    if table:
        x = F.coalesce(F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[x], x)
    return F.nullif(x, F.lit(""))
