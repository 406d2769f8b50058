import random
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from catalog import etl
from gradus.operators import matching, ranking, tables


SF = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_keep_first_follows_the_ordinal(spark):
    df = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "k string, o long, v string")
    assert rows(tables.keep_first(df, ["k"], ["o"]), "k", "v") == [("a", "x"), ("b", "z")]


def test_last_value_first_place(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, o long, v string")
    assert rows(tables.last_value_first_place(df, "k", "v", "o"), "k", "v", "o") == [("a", "z", 1), ("b", "y", 2)]


def test_concat_keeps_first_appearance(spark):
    data = [("a", "z", 1), ("a", "b", 2), ("a", "z", 3), ("a", None, 4), ("n", None, 5), (None, "q", 6)]
    df = spark.createDataFrame(data, "k string, v string, o long")
    assert rows(tables.ordered_distinct_concat(df, ["k"], "v", "o", "t"), "k", "t") == [("a", "z, b"), ("n", "")]


def test_parent_text_only_where_a_child_asks(spark):
    entities = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p"), (4, "q"), (5, "r"), (6, None)], "code long, parent string")
    said = spark.createDataFrame([(2, "c", 9), (2, "b", 8), (1, "a", 3), (1, "a", 2), (4, "d", 1)], "code long, t string, o long")
    got = tables.parent_texts(entities, said, "code", "parent", "t", "o", "of_parent")
    assert rows(got, "code", "of_parent") == [(3, "a, b, c")]  # nobody lacks a text under q, r has none to lend


@pytest.mark.skipif(not Path(SF).is_dir(), reason="driver tables not here")
def test_parent_text_fallback_carries_no_parent_text_for_others(spark, monkeypatch):
    seen = []
    kept = tables.ordered_distinct_concat
    monkeypatch.setattr(tables, "ordered_distinct_concat", lambda *a, **k: seen.append((a[1], kept(*a, **k))) or seen[-1][1])
    etl.parent_text_fallback(spark, SF).collect()
    (by_parent,) = [df for keys, df in seen if keys == ["parent"]]
    part = spark.read.parquet(f"{SF}/part.parquet")
    asked = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_returnflag = 'R'").select("l_partkey")
    asked = part.join(asked, part.p_partkey == asked.l_partkey, "left_anti").selectExpr("concat(p_brand, p_size)").distinct().count()
    assert by_parent.count() <= asked


def test_fallback_levels(spark):
    occ = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "code string")
    obs = spark.createDataFrame(
        [("a", "a", "ME", 10.0), ("a", "a", "ME", float("nan")), ("b1", "b", "ME", 20.0), ("c", "c", "NH", 30.0),
         ("c", "c", None, 99.0), (None, None, "ME", 1.0), ("a", "a", "NH", 5.0)],
        "code string, parent string, state string, v double",
    )
    state = F.col("state")
    levels = [
        tables.Level("home", state == "ME", "code", "code"), tables.Level("parent", state == "ME", "parent", "code"),
        tables.Level("near", state.isin("NH"), "code", "code"), tables.Level("all", state.isNull(), "code", "code"),
    ]
    out = tables.fallback_with_provenance(occ, obs, "v", levels, "code", "w", "src")
    assert rows(out, "code", "w", "src") == [
        ("a", 10.0, "home"), ("b", 20.0, "parent"), ("c", 30.0, "near"), ("d", None, "Missing")
    ]


def test_patch_changes_only_named_rows(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "k string, w double, s string")
    over = spark.createDataFrame([("b", 9.0, None)], "k string, w double, s string")
    assert rows(tables.patch(df, over, "k"), "k", "w", "s") == [("a", 1.0, "x"), ("b", 9.0, "y")]


def test_coverage_and_cache(spark):
    occ = spark.createDataFrame([("a",), ("b",)], "k string")
    kids = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert tables.coverage(occ, kids, "k").first()[:] == (2, 1, 1, 2)
    cache = spark.createDataFrame([("a", ["1"])], "k string, c array<string>")
    seen = []

    def mapper(fresh):
        seen.extend(r[0] for r in fresh.collect())
        return fresh.withColumn("c", F.array(F.lit("new")))

    full = tables.extend_cache(occ.unionByName(occ), cache, "k", mapper)
    assert seen == ["b"] and rows(full, "k", "c") == [("a", ["1"]), ("b", ["new"])]


def test_expand_codes(spark):
    members = spark.createDataFrame([("g", "all"), ("s", "own"), ("u", "own"), ("e", "own")], "n string, t string")
    mapping = spark.createDataFrame([("g", ["9"]), ("s", ["1"]), ("e", ["GENERAL"])], "n string, c array<string>")
    full = F.array(F.lit("1"), F.lit("2"))
    out = tables.expand_codes(members, mapping, "n", "c", full, F.col("t") == "all", "GENERAL", "code")
    assert rows(out, "n", "code") == [("e", "1"), ("e", "2"), ("g", "1"), ("g", "2"), ("s", "1"), ("u", "1"), ("u", "2")]


def test_first_match(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    left = [(i, word(rng.randint(0, 30))) for i in range(200)] + [(900, None), (901, "")]
    right = [(word(rng.randint(0, 9)), f"u{i}", i) for i in range(80)]
    want = {}
    for i, t in left:
        hits = [(o, u) for n, u, o in right if t is not None and (n == t or (len(n) >= 4 and n in t))]
        want[i] = min(hits)[1] if hits else None
    l = spark.createDataFrame(left, "id long, t string")
    r = spark.createDataFrame(right, "n string, u string, o long")
    for stretch in (matching.STRETCH, 7):
        out = matching.first_match(l, r, "id", "t", "n", "u", "o", "found", 4, stretch)
        assert dict(rows(out, "id", "found")) == want


def test_only_pieces_that_may_be_names_leave_a_text(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefgh é\U0001f600") for _ in range(n))
    names = sorted({word(rng.randint(6, 12)) for _ in range(300)} | {"x", ""})
    texts = [(i, word(rng.randint(0, 400))) for i in range(200)]
    texts = [(i, t[:40] + rng.choice(names) + t[40:] if i % 4 == 0 else t) for i, t in texts] + [(900, None), (901, ""), (902, "x"), (903, "ax")]
    real = {(i, n) for i, t in texts for n in names if t is not None and (n == t or (len(n) >= 6 and n in t))}
    assert {(901, ""), (902, "x")} <= real and len(real) > 50
    out = matching.probable_names(
        spark.createDataFrame(texts, "_lid long, _text string"), spark.createDataFrame([(n,) for n in names], "_name string"), 6
    )
    got = {tuple(r) for r in out.collect()}
    assert real <= got and len(got) <= len(real) + 10
    none = matching.probable_names(out.select("_lid", F.col("_name").alias("_text")), out.select("_name").where("false"), 6)
    assert none.count() == 0


def test_hot_keys_are_paged_whole(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") * 7).alias("o"))
    out = ranking.pages(df, ["k"], "o", F.col("o"), "items", page_size=100)
    hot = sorted((r["page"], r["items"]) for r in out.where("k = 'hot'").collect())
    assert [p for p, _ in hot] == list(range(7)) and all(len(i) == 100 for _, i in hot)
    assert [x for _, i in hot for x in i] == [7 * i for i in range(700)]
    small = ranking.rank_in_key(df, ["k"], "o", "r", width=50)
    assert rows(small.where("k = 'hot'"), "o", "r") == [(7 * i, i) for i in range(700)]


def test_global_index_both_ways(spark):
    df = spark.range(500).select(((F.col("id") * 37) % 500).alias("x"))
    for small in (1000, 10):
        assert rows(ranking.global_index(df, [F.col("x")], "i", small), "x", "i") == [(i, i) for i in range(500)]


def test_medians_both_ways(spark):
    rng = random.Random(5)
    data = [(k, v) for k, n in (("even", 400), ("odd", 301), ("one", 1)) for v in [rng.choice([rng.expovariate(1), 7.0]) for _ in range(n)]]
    data += [("even", None), ("odd", float("nan")), ("same", 3.0), ("same", 3.0), ("same", 3.0)]
    df = spark.createDataFrame(data, "k string, v double")
    plain = rows(ranking.group_medians(df, ["k"], "v", "m"), "k", "m", "n_values")
    for sketch in (10_000, 20, 5):
        assert rows(ranking.group_medians(df, ["k"], "v", "m", bound=5, fan=4, sketch=sketch), "k", "m", "n_values") == plain


def test_a_median_reads_its_rows_twice(spark):
    scans = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            scans.add(b.num_rows)
            yield b

    n = 20_000
    df = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 7919 % n).cast("double").alias("v")).mapInArrow(counted, "k string, v double")
    got = ranking.group_medians(df, ["k"], "v", "m", bound=50, fan=8).collect()
    assert [(r.k, r.m, r.n_values) for r in got] == [("k", (n - 1) / 2, n)]
    assert scans.value == 2 * n


def test_a_bracket_that_misses_the_middle_is_given_up(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(11)] + [("b", float(i % 3)) for i in range(12)], "k string, _v double")
    sizes = spark.createDataFrame([("a", 11, [7.0, 9.0]), ("b", 12, [1.0, 1.0])], "k string, n_values long, _q array<double>")
    got = ranking._bracketed(df, ["k"], sizes, 5)
    assert rows(got.where("k = 'a'"), "_v", "_c", "_below") == [(float(i), 1, 0) for i in range(11)]
    assert rows(got.where("k = 'b'"), "_v", "_c", "_below") == [(1.0, 4, 4)]


def test_relabel_keeps_noise(spark):
    df = spark.createDataFrame([(1, 7, 30.0), (2, 7, 50.0), (3, 2, 90.0), (4, -1, 1.0), (5, 9, 40.0)], "id long, l int, w double")
    out = ranking.relabel_by_median(df, "l", "w", "c")
    assert rows(out, "id", "c") == [(1, 0), (2, 0), (3, 2), (4, -1), (5, 1)]


def test_pages_of_a_hot_text_are_the_whole_text(spark):
    data = [("hot", f"v{i * 37 % 500}", i // 2) for i in range(1500)] + [("a", "z", 1), ("a", "b", 1), ("a", None, 0), ("n", None, 5), (None, "q", 6)]
    df = spark.createDataFrame(data, "k string, v string, o long")
    whole = dict(rows(tables.ordered_distinct_concat(df, ["k"], "v", "o", "t"), "k", "t"))
    got = {}
    for k, page, t in rows(tables.ordered_distinct_pages(df, ["k"], "v", "o", "t", page_size=60), "k", "page", "t"):
        assert page == len(got.setdefault(k, []))
        got[k].append(t)
    assert {k: "".join(parts) for k, parts in got.items()} == whole and len(got["hot"]) == 9
