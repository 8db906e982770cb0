"""Named datasets: how their raw tables are read and which columns are protected.

Bounds, categories and codes are not listed here; ``operators.profile`` derives them from the data.
"""

from __future__ import annotations

# Reader settings, dropped or kept columns, protected columns. The label is the last
# column unless ``target`` names it; ``age`` tells how the age column is cut into young and old.
DATASETS: dict[str, dict] = {
    "census": {"drop": ["education.num"], "age": "plain", "protected": ["sex", "race", "age"]},
    "bank": {"sep": ";", "age": "plain", "protected": ["age"]},
    "compas": {"protected": ["race", "age", "sex"]},
    "credit": {"protected": ["age", "sex"]},
    "default": {"lower": True, "drop": ["id"], "age": "plain", "protected": ["age", "sex"]},
    "diabetes": {"protected": ["Age"]},
    "heart": {"age": "plain", "protected": ["sex", "age"]},
    "students": {"sep": ";", "protected": ["age", "sex"]},
    "lawschool": {
        "target": "bar_passed",
        "keep": ["race1", "gender", "lsat", "ugpa", "zfygpa", "bar_passed", "id", "gpa", "age"],
        "age": "negated",
        "protected": ["race1", "gender", "age"],
    },
}

# Value lists of the bank table; a value's position is its code.
BANK_VALUES = {
    "job": [
        "admin.", "unknown", "unemployed", "management", "housemaid", "entrepreneur", "student",
        "blue-collar", "self-employed", "retired", "technician", "services",
    ],
    "marital": ["married", "divorced", "single"],
    "education": ["unknown", "secondary", "primary", "tertiary"],
    "default": ["no", "yes"],
    "housing": ["no", "yes"],
    "loan": ["no", "yes"],
    "contact": ["unknown", "telephone", "cellular"],
    "month": ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"],
    "poutcome": ["unknown", "other", "failure", "success"],
    "y": ["no", "yes"],
}

# Scale, lower and upper limit of the numeric bank columns.
BANK_SCALES = {"age": (10, 1, 9), "balance": (50, -20, 179), "duration": (10, 0, 99), "previous": (1, 0, 1)}

# Codes of the categories in a ``Key: value`` answer about a person.
ANSWER_CODES = {
    "Workclass": {
        "Private": 1, "Self-emp-not-inc": 2, "Self-emp-inc": 3, "Federal-gov": 4, "Local-gov": 5,
        "State-gov": 6, "Without-pay": 7, "Never-worked": 8,
    },
    "Education": {
        "Bachelors": 1, "Some-college": 2, "11th": 3, "HS-grad": 4, "Prof-school": 5, "Assoc-acdm": 6,
        "Assoc-voc": 7, "Doctorate": 8, "Masters": 9, "10th": 10, "7th-8th": 11, "5th-6th": 12, "Preschool": 13,
    },
    "Marital Status": {
        "Married-civ-spouse": 1, "Divorced": 2, "Never-married": 3, "Separated": 4, "Widowed": 5,
        "Married-spouse-absent": 6, "Married-AF-spouse": 7,
    },
    "Occupation": {
        "Tech-support": 1, "Craft-repair": 2, "Other-service": 3, "Sales": 4, "Exec-managerial": 5,
        "Prof-specialty": 6, "Handlers-cleaners": 7, "Machine-op-inspct": 8, "Adm-clerical": 9,
        "Farming-fishing": 10, "Transport-moving": 11, "Priv-house-serv": 12, "Protective-serv": 13,
        "Armed-Forces": 14,
    },
    "Relationship": {
        "Wife": 1, "Own-child": 2, "Husband": 3, "Not-in-family": 4, "Other-relative": 5, "Unmarried": 6,
    },
    "Race": {"White": 1, "Asian-Pac-Islander": 2, "Amer-Indian-Eskimo": 3, "Other": 4, "Black": 5},
    "Sex": {"Female": 0, "Male": 1},
    "Native Country": {
        "United-States": 1, "Cambodia": 2, "England": 3, "Puerto-Rico": 4, "Canada": 5, "Germany": 6,
        "India": 7, "Japan": 8, "Greece": 9, "China": 10, "Cuba": 11, "Iran": 12,
    },
}
ANSWER_NUMBERS = ["Age", "Capital Gain", "Capital Loss", "Hours per Week"]

# Student columns that are not label-encoded, and those whose codes start at 1.
STUDENT_PLAIN = ["age", "absences", "G1", "G2", "G3"]
STUDENT_SHIFTED = [
    "Mjob", "Fjob", "guardian", "famrel", "reason", "traveltime", "studytime", "failures", "freetime",
    "Dalc", "Walc", "health", "goout",
]
