"""Row types of the review domain, and the fixed values that its rules use."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


S, L, I, D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()

REVIEW = _struct(drug_name=S, brand_name=S, date=S, user=S, age=S, gender=S, patient_type=S, medication_duration=S, condition=S, overall_rating=D, effectiveness=I, ease_of_use=I, satisfaction=I, likes=I, dislikes=I, textual_review=S)
SIDE_EFFECT = _struct(name=T.ArrayType(S), severity=S, associated_drug=S)
STRUCTURED_INFO = _struct(drug=_struct(name=S, dosage=S, dosage_form=S, duration=S, continued_use=S, alternative_drug_considered=S), condition=_struct(name=S, severity=S), side_effects=T.ArrayType(SIDE_EFFECT))
NODE = _struct(label=S, properties=_struct(name=S))
RELATION = _struct(start=NODE, end=NODE, relation=S, properties=_struct(approval=S, off_label=S, severity=S, dosage=S))
EDGE_COLUMNS = ("src_label", "src", "rel", "dst_label", "dst")

# Products by generic name, in catalog order.
BRANDS = {
    "Wegovy": "Semaglutide",
    "Ozempic": "Semaglutide",
    "Rybelsus": "Semaglutide",
    "Zepbound": "Tirzepatide",
    "Mounjaro": "Tirzepatide",
    "Victoza": "Liraglutide",
    "Saxenda": "Liraglutide",
}
# How products are given, and what they are approved for.
DOSAGE_FORMS = {"subcutaneous injection": ["mounjaro", "ozempic", "wegovy", "zepbound", "victoza", "saxenda"], "oral": ["rybelsus"]}
INDICATIONS = {"weight": ["wegovy", "zepbound", "saxenda"], "diabetes": ["ozempic", "rybelsus", "mounjaro", "victoza"]}
SEVERITIES = ["mild", "moderate", "severe"]
# Words that route a question.
GRAPH_KEYWORDS = ["side effect", "treats", "causes", "generic name", "approved for"]
TABLE_KEYWORDS = ["average", "rating", "satisfaction", "how many", "compare", "users say", "like", "dislike"]
SUMMARY_KEYWORDS = [
    "best thing", "good thing", "positive", "pros", "advantages", "benefits",
    "worst thing", "bad thing", "negative", "cons", "disadvantages", "downsides",
    "biggest downside", "biggest problem", "main issue", "major side effect",
    "people say", "users say", "reviews say", "what do people think",
    "overall opinion", "general feedback", "user experience",
    "highlight", "standout", "notable", "remarkable",
    "summary", "overview", "tell me about",
]
# The words that a yes/no column may hold, and the labels that edges may join.
BOOLEAN_WORDS = ["true", "false", "yes", "no", "0", "1", "nan", "none", "<na>"]
TRUE_WORDS = ["true", "yes", "1"]
FALSE_WORDS = ["false", "no", "0"]
LABELS = {"Medication": "Drug", "Disease": "Condition"}
NODE_LABELS = ["Drug", "Condition", "SideEffect"]
AGE_OPEN_END = 999
