"""Attribution phrases with a discard or complex code are phrases like others: the last one counts."""

from dyadflow.operators import coder as N
from dyadflow.plans import QUERIES
from dyadflow.plans.views import frame

SF = "/root/testdata/sf0.001"


def test_marked_phrases_name_an_actor(spark):
    units = [("a", 0, "actor", "X"), ("a", 1, "attrib", "R"), ("a", 2, "actor", "Y"), ("a", 3, "attrib", "###"), ("b", 0, "actor", "X"), ("b", 1, "attrib", "+++"), ("c", 0, "actor", "X"), ("c", 1, "attrib", "R"), ("c", 2, "attrib", "---")]
    out = N.attribution(spark.createDataFrame(units, "doc string, i int, wtype string, code string"))
    got = {r.doc: (r.attrib, r.code, r.named) for r in out.collect()}
    assert got == {"a": (None, "###", "Y"), "b": (None, "+++", "X"), "c": ("X", None, "X")}


def test_no_document_is_left_out(spark):
    coded = frame(spark, SF, "SELECT DISTINCT doc FROM units WHERE wtype = 'attrib' AND code <> '---'")
    only = frame(spark, SF, "SELECT doc FROM units WHERE wtype = 'attrib' AND code <> '---' GROUP BY doc HAVING bool_and(code = '###')")
    assert only.count() > 0
    assert {r.doc for r in QUERIES["k20_attribution"](spark, SF).collect()} == {r.doc for r in coded.collect()}
