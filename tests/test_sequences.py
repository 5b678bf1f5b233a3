from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from genoloom.functions import sequences as q


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_strand_and_slice(spark):
    assert one(spark, q.stranded(q.slice_bases(F.lit("AACGTTN"), F.lit(1), F.lit(5)), F.lit("-"))) == "ACGT"
    assert one(spark, q.stranded(F.lit("AACG"), F.lit("?"))) == "AACG"
    assert one(spark, q.reverse_complement(F.lit("ACGTRYKMBN"))) == "NVKMRYACGT"


def test_translation(spark):
    assert one(spark, q.translate_cds(F.lit("ATGTAAaaa"))) == "MK"  # internal stop vanishes
    assert one(spark, q.translate_cds(F.lit(""))) == ""
    assert one(spark, q.translate_cds(F.lit("AT"))) == ""
    assert one(spark, q.translate_cds(F.lit("GCNRAYSARNNNTAR"))) == "ABZX"
    assert one(spark, q.translate_cds(F.lit("TGA"), 4)) == "W"
    assert len(q.code(2)) == 64 and q.code(1) == q.code(11)


def test_back_translation(spark):
    assert one(spark, q.back_translate(F.lit("-M-K"), F.lit("ATGAAA"))) == "---ATG---AAA"
    assert one(spark, q.back_translate(F.lit(""), F.lit("ATG"))) == ""


def test_attributes_and_ids(spark):
    a = F.lit("ID=a;gene=x y;ID=b;product=p, q")
    assert one(spark, q.attribute(a, "ID")) == "b"
    assert one(spark, q.attribute(a, "none")) is None
    assert one(spark, q.attribute(a, "product")) == "p, q"
    assert one(spark, q.clean_name(F.lit("abé-1 x"))) == "abé_1_x"
    for raw, want in (("t", "s-c-t"), ("s-t", "s-c-t"), ("s-c-t", "s-c-t"), ("c-t", "s-c-t"), ("a-b", "s-c-a-b")):
        assert one(spark, q.canonical_gene_id(F.lit(raw), F.lit("s"), F.lit("c"))) == want
    assert one(spark, q.seq_ids(F.lit("s-c-a-b"))).asDict() == {"sample_id": "s", "seq_id": "c"}
    assert one(spark, q.suffixed(F.lit("g"), F.lit(7))) == "g_00007"


def test_rounding_is_python_rounding(spark):
    for v in (2.675, 1.005, 0.125, 301.5, 1 / 3):
        assert one(spark, q.rounded(F.lit(v))) == round(v, 2)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text("ACGT", min_size=0, max_size=40))
def test_reverse_complement_twice(spark, s):
    assert one(spark, q.reverse_complement(q.reverse_complement(F.lit(s)))) == s
