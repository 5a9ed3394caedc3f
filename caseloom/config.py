"""Fixed values and settings shared by the package."""

from __future__ import annotations

from dataclasses import dataclass

# Quarters loaded when the caller names none.
QUARTERS = ["2022q1", "2022q2", "2022q3", "2022q4", "2023q1", "2023q2", "2023q3"]

# Outcome codes that make a case serious.
SERIOUS_OUTCOMES = ["DE", "LT", "HO", "DS", "CA", "RI"]

# Clinical abbreviations and what they stand for.
ABBREVIATIONS = {
    "QD": "once daily",
    "BID": "twice daily",
    "TID": "three times daily",
    "QID": "four times daily",
    "PRN": "as needed",
    "IV": "intravenous",
    "IM": "intramuscular",
    "SC": "subcutaneous",
    "PO": "oral",
    "SOB": "shortness of breath",
    "CP": "chest pain",
    "HA": "headache",
}

# Text used for a case without any narrative part.
EMPTY_NARRATIVE = "no clinical information available"

# Separator of multi-valued fields.
VALUE_SEPARATOR = " | "

# Model inputs, in the order of the feature vector.
NUMERIC_FEATURES = ["age", "wt", "drug_seq", "dose_amt", "dur"]
CATEGORICAL_FEATURES = ["sex", "occr_country", "dose_freq", "dechal", "rechal", "route"]
FLAG_FEATURES = ["is_elderly", "is_pediatric", "polypharmacy", "high_dose", "long_duration"]
FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES + FLAG_FEATURES

# What a score request does not carry.
REQUEST_DEFAULTS = {"drug_seq": 1, "dechal": "unknown", "rechal": "unknown", "occr_country": "US"}

# Texts of raw files that mean "missing". In the country column "NA"
# is a country and stays.
NULL_TEXTS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
              "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
COUNTRY_COLUMN = "occr_country"

# Vocabularies of the synthetic case generator.
DEMO_DRUGS = ["Aspirin", "Metformin", "Lisinopril", "Atorvastatin", "Amoxicillin",
              "Ibuprofen", "Omeprazole", "Amlodipine", "Metoprolol", "Warfarin"]
DEMO_REACTIONS = ["nausea", "headache", "dizziness", "rash", "fatigue",
                  "chest pain", "dyspnea", "bleeding", "liver injury", "anaphylaxis"]
DEMO_ROUTES = ["oral", "intravenous", "subcutaneous", "intramuscular", "topical"]
DEMO_COUNTRIES = ["US", "GB", "DE", "FR", "JP"]
DEMO_DOSES = [10, 25, 50, 100, 200, 500]
DEMO_FREQUENCIES = ["QD", "BID", "TID", "QID", "PRN"]
DEMO_CHALLENGE = ["Y", "N", "U"]

# Points of the risk rule for old age, many drugs and a reaction, the span of its noise, and the reactions.
RISK_POINTS = {"age": 0.3, "drugs": 0.2, "reaction": 0.4, "noise": 0.3}
RISK_REACTIONS = "bleeding|anaphylaxis|liver"

# Wording of scored reports.
HIGH_RISK, LOW_RISK = "HIGH RISK", "LOW RISK"
HIGH_RISK_MARK, LOW_RISK_MARK = "🔴", "🟢"
RAISES, LOWERS = "increases risk", "decreases risk"
FACTOR_LINE = "• %s: %+.4f (%s)"
# Fixed value: a whole report, with places for mark, label, score and factor lines.
REPORT = """
## %s %s

**ADR Risk Score:** `%.4f`

---

### 🔍 Top Contributing Factors
%s
"""

SEED = 42


@dataclass(frozen=True)
class TreeSettings:
    """Boosted-tree settings; the defaults are the full-size model."""

    trees: int = 500
    depth: int = 6
    rate: float = 0.05
    row_share: float = 0.8
    feature_share: float = 0.8
    seed: int = SEED


@dataclass(frozen=True)
class FusionSettings:
    """Kind of embedding (``projection`` or ``word2vec``) and the late-fusion network."""

    embedding: str = "projection"
    hidden_dim: int = 256
    iterations: tuple[int, ...] = (25, 50, 100)
    seed: int = SEED
