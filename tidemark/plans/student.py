"""The student table: its coded schema and its currency rules."""

from pyspark.sql import types as T

from tidemark.operators.rule_graph import RuleBook

# Names, order and types of the coded input format.
CODED_SCHEMA = T.StructType(
    [
        T.StructField("eId", T.ShortType(), False),
        T.StructField("vId", T.StringType(), False),
        *[T.StructField(c, T.ByteType(), False) for c in ("name", "age", "city", "grade", "status")],
    ]
)

# Older code -> newer code.
GRADE_CODES = [
    ("1", "3"), ("2", "3"), ("3", "4"), ("3", "6"), ("4", "5"), ("5", "7"),
    ("6", "7"), ("7", "8"), ("7", "9"), ("8", "10"), ("9", "10"),
]
STATUS_CODES = [
    ("1", "2"), ("2", "3"), ("2", "6"), ("3", "4"), ("4", "5"), ("5", "8"),
    ("6", "7"), ("7", "8"), ("8", "9"), ("8", "10"),
]
# Fixed value: the declared direction of age.
AGE_DIRECTION = ("low", "high")
# The same attributes as labels.
GRADE_LABELS = [("HighSchool", "Bachelor"), ("Bachelor", "Master"), ("Master", "PHD"), ("PHD", "Graduate")]
STATUS_LABELS = [("Single", "Married"), ("Married", "Divorced"), ("Divorced", "Remarried")]


def coded_rules() -> RuleBook:
    return RuleBook({"grade": GRADE_CODES, "status": STATUS_CODES}, {"age": AGE_DIRECTION})


def label_rules() -> RuleBook:
    return RuleBook({"grade": GRADE_LABELS, "status": STATUS_LABELS}, {"age": AGE_DIRECTION})
