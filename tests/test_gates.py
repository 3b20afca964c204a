"""Gates of both kinds, case by case, with their reasons."""

import pytest
from pyspark.sql import functions as F

from focusloom import config as C
from focusloom.functions import text as T

OPEN_GRAPH, OPEN_SPHERE = "metadata allowed by current graph depth", "redacted metadata allowed by current policy"
HIDDEN, REPLACED, MARKED = "window title capture is disabled", "sensitive window title was replaced", "label contains a redaction placeholder"


@pytest.mark.parametrize(
    "label, findings, graph, sphere",
    [
        ("parser work", {}, ("allowed", "low", OPEN_GRAPH), ("allowed", "low", OPEN_SPHERE)),
        ("parser work", {"phone": 1, "email": 2}, ("masked", "medium", "redaction findings: email, phone"), ("masked", "medium", "redaction findings: email, phone")),
        ("to [EMAIL]", {}, ("masked", "medium", MARKED), ("masked", "medium", MARKED)),
        (C.REDACTED_TITLE, {"email": 1}, ("masked", "high", REPLACED), ("masked", "high", REPLACED)),
        (C.NO_TITLE, {}, ("generalized", "low", HIDDEN), ("generalized", "low", HIDDEN)),
        (f"{C.NO_TITLE} [secret]", {}, ("generalized", "low", HIDDEN), ("masked", "medium", MARKED)),  # the two gates ask in another order
        (f"{C.NO_TITLE} {C.REDACTED_TITLE}", {}, ("generalized", "low", HIDDEN), ("masked", "high", REPLACED)),
        (None, {}, ("allowed", "low", OPEN_GRAPH), ("allowed", "low", OPEN_SPHERE)),
    ],
)
def test_gates(spark, label, findings, graph, sphere):
    row = spark.createDataFrame([(label, findings)], "label string, findings map<string,int>")
    has = F.size("findings") > 0
    got = row.select(T.gate_for_label(F.col("label"), has, F.col("findings")).alias("g"), T.gate_for_event(F.col("label"), F.lit(""), has, F.col("findings")).alias("s")).first()
    assert tuple(got.g) == graph and tuple(got.s) == sphere
