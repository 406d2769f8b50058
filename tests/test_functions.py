import math
from urllib.parse import quote

from pyspark.sql import functions as F

from gradus import fixed
from gradus.functions import numeric, text, vectors


def values(spark, data, kind, *columns):
    df = spark.createDataFrame([(x,) for x in data], f"x {kind}")
    return [r[0] for r in df.select(*columns).collect()]


def test_codes(spark):
    data = ["47-2031.00", " 17-2051.01 ", "header text", None, "47-20", "\t11-9021"]
    x = F.col("x")
    assert values(spark, data, "string", text.clean_code(x)) == ["47-2031", "17-2051.01", "header text", None, "47-20", "11-9021"]
    assert values(spark, data, "string", text.is_code(x)) == [True, False, False, False, False, False]
    assert values(spark, ["1.00.00"], "string", text.clean_code(x)) == ["1"]


def test_names(spark):
    data = ["X Electric", "Y, Inc", " Z LLC ", "Harbor Electric"]
    want = [s.lower().strip().rstrip(".,inc lc").strip() for s in data]
    assert values(spark, data, "string", text.normalize_name(F.col("x"))) == want


def test_percent_encoding(spark):
    data = ["Plumbers, Pipefitters & Co", "a/b~c*d (e) é+%"]
    assert values(spark, data, "string", text.percent_encode(F.col("x"))) == [quote(s) for s in data]


def test_credentials(spark):
    data = ["Short-term", "AAS Degree", "AAS Degree, Certificate", "Certificate", "B.S.", None]
    want = ["certificate", "associate", "associate_or_certificate", "certificate", "unknown", "unknown"]
    assert values(spark, data, "string", text.credential_type(F.col("x"))) == want


def test_wage_text_and_tiers(spark):
    x = F.col("x")
    assert values(spark, ["61890", "*", "#", "", None, "NaN"], "string", numeric.to_double(x)) == [61890.0] + [None] * 5
    tiers = [label for _, label in fixed.TIERS]
    data = [54999.99, 55000.0, 79999.99, 80000.0, 110000.0, None]
    assert values(spark, data, "double", numeric.tier(x)) == [tiers[i] for i in (0, 1, 1, 2, 3, 3)]
    assert values(spark, [10.0, 40000.0, 95000.0, 1e6], "double", numeric.bubble_size(x)) == [12, 12, 26, 40]


def test_effective_wage_and_roi(spark):
    x = F.col("x")
    assert values(spark, [None, 0.0, 52000.0], "double", numeric.effective_wage(x, F.lit(1.0))) == [1.0, 1.0, 52000.0]
    rows = values(spark, [60000.0, 50000.0, 40000.5], "double", numeric.roi(F.lit(50000.0), x))
    assert rows[0].breakeven_months == 6.0 and rows[0].five_year_net_gain == 45000.0
    assert rows[1].breakeven_months is None and rows[1].five_year_net_gain == -5000.0
    assert rows[2].annual_salary_uplift == -10000.0  # half to even


def test_skill_gap(spark):
    source = "weld steel, beams and pipes"
    target = "Weld steel beams; operate cranes safely using machinery machinery inspect"
    df = spark.createDataFrame([(source, target)], "s string, t string")
    got = df.select(text.skill_gap(text.words(F.col("s")), text.skill_words(F.col("t")), 3)).first()[0]
    assert got == ["machinery", "inspect", "operate"]


def test_topic_tokens(spark):
    got = values(spark, ["Tasks: Cut pipe, fittings,valves. Skills: work Reading x1y2 Math"], "string", text.topic_tokens(F.col("x")))
    assert got == [["pipe", "reading", "math"]]
    pairs = values(spark, ["alpha beta gamma"], "string", text.uni_and_bigrams(F.split("x", " ")))
    assert pairs == [["alpha", "beta", "gamma", "alpha beta", "beta gamma"]]
    assert values(spark, [""], "string", text.uni_and_bigrams(F.filter(F.split("x", " "), lambda t: t != ""))) == [[]]


def test_topic_tokens_are_found_in_one_pass(spark):
    data = ["abcd,ef gh,ij ,,,, a,b,c ΣΑΣ,ΟΔΟΣ İİİİ with,that", None, "abcde1 abcd\x85wxyz\x1cnaïve.", "(abcd) stop-word\nABCD,\n"]
    tokens = text.topic_tokens(F.col("x"))
    want = [["abcd", "ef", "gh", "ij", "σας", "οδος", "i̇i̇i̇i̇"], None, ["abcd", "wxyz"], ["abcd"]]
    assert values(spark, data, "string", tokens) == want
    plan = spark.createDataFrame([("",)], "x string").select(tokens)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "RLIKE" not in plan.upper()


def test_code_lists(spark):
    valid = F.array(F.lit("a"), F.lit("b"))
    data = ['["a","z"]', '["z"]', "[]", '["GENERAL"]', "not json", None]
    want = [["a"]] + [["GENERAL"]] * 5
    assert values(spark, data, "string", text.parse_codes(F.col("x"), valid)) == want


def test_vectors(spark):
    x = F.col("x")
    assert values(spark, [[3.0, 4.0], [0.0, 0.0]], "array<double>", vectors.unit(x)) == [[0.6, 0.8], [0.0, 0.0]]
    assert values(spark, [[1.0, 3.0], [0.0, 0.0]], "array<double>", vectors.shares(x)) == [[0.25, 0.75], [0.0, 0.0]]
    assert values(spark, [[0.0, 0.0]], "array<double>", vectors.cosine(x, x)) == [0.0]
    got = values(spark, [[1.0, 0.0, 0.0], [1 / 3] * 3, [1.0]], "array<double>", vectors.entropy(x))
    assert got[0] == 0.0 and math.isclose(got[1], 1.0) and got[2] == 0.0


def test_min_max_of_a_constant_is_zero(spark):
    assert values(spark, [5.0], "double", numeric.min_max(F.col("x"), F.lit(5.0), F.lit(5.0))) == [0.0]
