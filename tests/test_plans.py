import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus import fixed
from gradus.functions import numeric, text
from gradus.operators import choose, features, topics
from gradus.plans import clustering, employers, galaxy, occupations, programs, recommend, store
from gradus.plans import topics as topic_plan
from gradus.schemas import keep_existing, require_columns, schema
from gradus.sources import files
from gradus.streaming.requests import answer_requests

WIDTH = 6
METHODS = {"progress": "kmeans", "pivot": "gmm", "field_change": "agglomerative", "skill_match": "hdbscan"}
SKILLS = [
    "Tasks: measure lumber, install frames. Skills: carpentry reading",
    "Tasks: install conduit, inspect wiring. Skills: electrical reading",
    "Tasks: supervise crews, schedule projects. Skills: management coordination",
    "Tasks: operate cranes, inspect cables. Skills: operation monitoring",
]


@pytest.fixture(scope="module")
def occ(spark):
    rng = np.random.default_rng(2)
    data = []
    for i in range(12):
        data.append(
            (i, f"47-{2000 + i}", f"Job {i}", "does things", 40000.0 + 5000 * i, "home", SKILLS[i % 4],
             rng.normal(size=WIDTH).tolist(), i % 3, i % 2, i // 6, -1 if i == 0 else 0, 0.1 * (i % 4))
        )
    df = spark.createDataFrame(
        data,
        "ordinal long, soc_code string, occ_title string, role_description string, median_wage_me double, wage_source string, "
        "skill_description string, embedding array<double>, cluster_kmeans int, cluster_gmm int, cluster_agglom int, "
        "cluster_hdbscan int, boundary double",
    )
    return df.withColumn("wealth_tier", numeric.tier(F.col("median_wage_me"))).persist()


def support(spark):
    t = spark.createDataFrame(
        [("47-2011", i, f"P{i}", None) for i in range(5)] + [("47-2010", 9, "Q", "u")],
        "soc_code string, ordinal long, program_name string, url string",
    )
    e = spark.createDataFrame([("47-2011", 1, "E1"), ("47-2009", 2, "E2")], "soc_code string, ordinal long, employer_name string")
    return t, e


def test_recommend(spark, occ):
    requests = spark.createDataFrame(
        [(1, "47-2003", "progress", 3, None), (2, "47-2003", "pivot", 3, 52000.0), (3, "47-2003", "field_change", 3, None),
         (4, "99-0000", "progress", 3, None), (5, "47-2011", "pivot", 5, None), (6, "47-2003", "progress", 1, 0.0)],
        schema("recommend_requests"),
    )
    modes = {m: METHODS[m] for m in ("progress", "pivot", "field_change")}
    paged = recommend.support_pages(*support(spark), page_size=2)
    out = recommend.recommend(requests, occ, modes, WIDTH, paged)
    rows = out.collect()
    by = lambda q: [r for r in rows if r["query_id"] == q]
    assert [r["status"] for r in by(4)] == ["unknown_code"] and [r["status"] for r in by(5)] == ["no_candidates"]
    assert {r["rank"] for r in by(1)} == {1, 2, 3} and {r["rank"] for r in by(6)} == {1}
    assert all(r["target_median_wage"] > 55000 for r in by(1) + by(2))
    cluster = {r["soc_code"]: r for r in occ.collect()}
    assert all(cluster[r["target_soc"]]["cluster_gmm"] != cluster["47-2003"]["cluster_gmm"] for r in by(2))
    assert {r["wage_source"] for r in by(2)} == {"user-reported"} and {r["wage_source"] for r in by(6)} == {"SOC median"}
    assert all(r["roi"]["wage_used_for_roi"] == 52000.0 for r in by(2))
    for r in rows:
        if r["rank"] is not None:
            assert r["training_programs"] is not None and r["employers"] is not None
    hot = [r for r in rows if r["target_soc"] == "47-2011" and r["query_id"] == 3 or r["target_soc"] == "47-2011"]
    for q in {r["query_id"] for r in hot}:
        listed = sorted((r["page"], [p["program_name"] for p in r["training_programs"]]) for r in hot if r["query_id"] == q)
        assert [x for _, xs in listed for x in xs] == [f"P{i}" for i in range(5)]
    card = recommend.cards(out).where("query_id = 1 AND rank = 1").first()
    best = [r for r in by(1) if r["rank"] == 1 and r["page"] == 0][0]
    assert card["wage_from"] == "$55k" and card["skills"] == best["skills_to_acquire"][:5] and len(card["programs"]) <= 3
    assert card["uplift_pct"] == round((best["target_median_wage"] / 55000 - 1) * 100)
    docs = recommend.responses(out, ["soc_code", "mode"], {"encoder": "none"}).where("query_id = 1 AND page = 0").collect()
    assert [p["rank"] for p in docs[0]["pathways"]] == [1, 2, 3] and docs[0]["metadata"] == {"encoder": "none"}


def test_text_requests(spark, occ):
    encoder = features.HashedTfIdf.fit(occ, "skill_description", 64)
    coded = encoder.encode(occ.drop("embedding"), "skill_description", "embedding")
    assert all(abs(np.linalg.norm(r[0]) - 1) < 1e-9 for r in coded.select("embedding").collect())
    requests = spark.createDataFrame(
        [(1, "I operate cranes and inspect cables", 3, 50000.0, 65000.0), (2, "I install conduit and wiring", 2, None, None),
         (3, "supervise crews and projects", 3, None, 900000.0)],
        schema("text_requests"),
    )
    out = recommend.recommend_from_text(encoder.encode(requests, "skills_text", "vec"), coded, METHODS, 64)
    rows = {(r["query_id"], r["rank"]): r for r in out.collect()}
    assert rows[(1, 1)]["target_soc"] in {"47-2007", "47-2011"} and all(r["target_median_wage"] >= 65000 for k, r in rows.items() if k[0] == 1)
    assert rows[(1, 1)]["closest_soc_match"]["soc_code"] == rows[(1, 1)]["target_soc"]
    assert rows[(2, 1)]["effective_wage"] == 45000.0 and rows[(2, 1)]["wage_source"] == "default ($45,000)"
    assert rows[(3, None)]["status"] == "no_candidates"
    closest = encoder.encode(requests.withColumn("top_k", F.lit(2)), "skills_text", "vec")
    found = recommend.find_closest(closest, coded, 64).where("query_id = 2").orderBy("rank").collect()
    assert len(found) == 2 and found[0]["soc_code"] == rows[(2, 1)]["target_soc"]
    hooked = features.encode_with(requests, "skills_text", "v", lambda: lambda texts: np.ones((len(texts), 4)))
    assert hooked.first()["v"] == [0.5] * 4


def test_request_rules(spark):
    data = [(1, "a", "progress", 3, None), (2, "a", "sideways", 3, None), (3, "a", "pivot", 6, None), (4, "a", "pivot", 1, 1.0), (5, "a", None, 1, None)]
    valid, rejected = recommend.split_requests(spark.createDataFrame(data, schema("recommend_requests")), "recommend")
    assert sorted(r["query_id"] for r in valid.collect()) == [1, 5] and rejected.count() == 3
    assert {r["mode"] for r in valid.collect()} == {"progress"}
    texts = [(1, "x" * 10, 1, None, None), (2, " " * 12, 1, None, None), (3, "short", 1, None, None), (4, "x" * 10, 1, None, 100.0), (5, None, 1, None, None)]
    valid, _ = recommend.split_requests(spark.createDataFrame(texts, schema("text_requests")), "from_text")
    assert [r["query_id"] for r in valid.collect()] == [1]
    valid, _ = recommend.split_requests(spark.createDataFrame([(1, "abcde", 5), (2, "abcd", 1), (3, "abcde", 0)], schema("closest_requests")), "closest")
    assert [r["query_id"] for r in valid.collect()] == [1]


def test_method_choice(spark):
    good = {"kmeans": 0.0609, "gmm": 0.0565, "agglomerative": 0.0661, "hdbscan": 0.0837}
    scores = choose.score_table(spark, good)
    hints = {r["use"]: r["method"] for r in choose.hints(scores).collect()}
    assert hints == {"overall": "hdbscan", **METHODS} and choose.method_map(scores) == METHODS
    assert [r["method"] for r in choose.ranked_methods(scores).orderBy("place").collect()] == ["hdbscan", "agglomerative", "kmeans", "gmm"]
    weak = choose.score_table(spark, {"kmeans": -0.1, "gmm": 0.2, "agglomerative": 0.2, "hdbscan": -1.0})
    hints = {r["use"]: r["method"] for r in choose.hints(weak).collect()}
    assert hints == {"overall": "gmm", "progress": "kmeans", "pivot": "gmm", "field_change": "agglomerative", "skill_match": "gmm"}
    assert choose.method_map(weak)["progress"] == "gmm"
    none = choose.score_table(spark, dict.fromkeys(good, -1.0))
    assert set(choose.method_map(none).values()) == {"kmeans"}


def test_full_run_is_stored_and_answers(spark, occ, tmp_path):
    names = ["soc_code", "occ_title", "role_description", "median_wage_me", "wage_source", "skill_description", "ordinal", "embedding"]
    result = clustering.cluster(occ.select(names), WIDTH)
    n = occ.count()
    assert result.occupations.count() == n and result.merges.count() == n - 1 and result.neighbours.count() == 6 * n
    overview = clustering.cluster_overview(result.occupations)
    assert {r["method"]: r["n"] for r in overview.groupBy("method").agg(F.sum("n_occupations").alias("n")).collect()} == dict.fromkeys(METHODS.values(), n)
    members = clustering.cluster_members(result.occupations)
    assert members.select(F.sum(F.size("occupations"))).first()[0] == 4 * n
    store.save_run(result, str(tmp_path), "hashed", WIDTH)
    loaded, scores, method_of = store.load_run(spark, str(tmp_path))
    meta = json.loads((spark.read.text(f"{tmp_path}/clustering_meta").first())[0])
    assert meta["n_occupations"] == n and set(meta["methods"]) == set(METHODS.values())
    assert clustering.status(loaded, scores, result.hints).count() == 4
    modes = {m: method_of[m] for m in ("progress", "pivot", "field_change")}

    incoming = tmp_path / "in"
    incoming.mkdir()
    lines = [{"query_id": 1, "soc_code": "47-2001", "mode": "progress", "top_n": 2}, {"query_id": 2, "soc_code": "47-2001", "mode": "?", "top_n": 2}]
    (incoming / "a.json").write_text("\n".join(map(json.dumps, lines)))
    answer = lambda batch: recommend.recommend(batch, loaded, modes, WIDTH)
    query = answer_requests(spark, str(incoming), str(tmp_path / "out"), str(tmp_path / "cp"), "recommend", answer)
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/answers")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out/rejected")).first()["error"] == "unknown mode"

    points = galaxy.galaxy_points(result.occupations, "kmeans").collect()
    assert len(points) == n and abs(sum(p["x"] for p in points)) < 1e-2


def test_map_projection_matches_an_eigendecomposition(spark, occ):
    x = np.array([r["embedding"] for r in occ.orderBy("ordinal").collect()])
    c = x - x.mean(0)
    _, _, vt = np.linalg.svd(c, full_matrices=False)
    want = np.stack([c @ (v * np.sign(v[np.abs(v).argmax()])) for v in vt[:2]], axis=1)
    got = np.array([[r["x"], r["y"]] for r in galaxy.project(occ, "embedding").orderBy("ordinal").collect()])
    np.testing.assert_allclose(got, want, atol=1e-4)


def test_topics(spark, occ):
    result = topic_plan.run_topics(occ, "both", n_topics=3, max_iter=10)
    rows = result.profiles.collect()
    assert len(rows) == 12 and all(len(r["lda_topics"]) == 3 for r in rows)
    for r in rows:
        assert abs(sum(r["lda_weights"]) - 1) < 1e-6
        assert abs(sum(r["nmf_weights"]) - 1) < 1e-6 or sum(r["nmf_weights"]) == 0
    assert topic_plan.topic_meta(result, "both").count() == 6
    assert topic_plan.run_topics(occ, "nmf", n_topics=2).profiles is None


def test_factorisation_error_falls(spark):
    rng = np.random.default_rng(0)
    x = rng.random((60, 3)) @ rng.random((3, 20))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "weights array<double>").repartition(3)
    factors = topics.fit_nmf(df, k=3, max_iter=30, tol=0.0)
    assert all(b <= a + 1e-9 for a, b in zip(factors.errors, factors.errors[1:]))
    assert factors.error < 0.05 * np.linalg.norm(x)
    zero = topics.fit_nmf(df.select(F.transform("weights", lambda v: v / 100).alias("weights")), k=3, max_iter=5, alpha=0.1)
    assert np.allclose(zero.h, 0)


def test_topic_ties_put_the_later_topic_first(spark):
    df = spark.createDataFrame([([0.0] * 8,)], "w array<double>")
    assert [t["topic_id"] for t in df.select(topics.top_topics("w")).first()[0]] == [7, 6, 5]


def test_occupation_master(spark):
    raw = spark.createDataFrame(
        [(1, "47-2031.00", "Carpenters"), (2, "47-2031", "Again"), (3, "Code", "Head"), (4, "17-2051.01", "T"), (5, "47-2171", "Rebar"), (6, "11-9021", "M"), (7, None, "x")],
        "ordinal long, soc_code string, occ_title string",
    )
    wages = spark.createDataFrame(
        [("47-2031", "ME", "50000"), ("47-2171", None, "44000"), ("47-2171", "PR", "1"), ("47-2171", "NH", "46000"), ("11-9021", "VT", "#"), ("11-9021", "VT", "90000"), ("11-9021", "NH", "100000")],
        schema("bls_wages"),
    )
    skills = spark.createDataFrame(
        [("47-2031.00", "IM", "Math", 1), ("47-2031.00", "IM", "Art", 2), ("47-2031.00", "IM", "Math", 3), ("47-2031.00", "LV", "No", 4), ("17-2051.01", "IM", "Design", 5)],
        "`O*NET-SOC Code` string, `Scale ID` string, `Element Name` string, ordinal long",
    )
    tasks = spark.createDataFrame([("47-2031.00", "Core", "Saw", 1), ("47-2031.00", "Supplemental", "Nap", 2)], "`O*NET-SOC Code` string, `Task Type` string, Task string, ordinal long")
    manual = spark.createDataFrame([("17-2051.01", 70510.0, "manual")], "soc_code string, median_wage_me double, wage_source string")
    out = occupations.build_occupations(raw, wages, skills, tasks, "ME", ["NH", "VT", "MA"], manual, averaged_codes=["47-2171"])
    got = {r["soc_code"]: (r["occ_title"], r["median_wage_me"], r["wage_source"], r["skill_description"]) for r in out.collect()}
    assert got == {
        "47-2031": ("Carpenters", 50000.0, "home", "Tasks: Saw. Skills: Math, Art"),
        "17-2051.01": ("T", 70510.0, "manual", "Tasks: . Skills: Design"),
        "47-2171": ("Rebar", 45000.0, "continental_avg", "Tasks: . Skills: "),
        "11-9021": ("M", 95000.0, "neighbour_avg", "Tasks: . Skills: "),
    }
    report = occupations.audit(out)
    assert report["still_missing"].count() == 0 and report["missing_values"].first()["missing_skill_description"] == 0


def test_programs(spark):
    titles = spark.createDataFrame([("47-2031", "Carpenters"), ("47-9999", "None")], "soc_code string, occ_title string")
    colleges = spark.createDataFrame([("ABC", "A B College")], "short string, full string")
    cc = spark.createDataFrame([("ABC", "Building", "AAS", None), ("X", None, "y", None)], schema("community_programs"))
    wi = spark.createDataFrame([("Academy", "focus", "all", "u")], schema("workforce_initiatives"))
    un = spark.createDataFrame([("U", "c", "BS", "Arch", "https://www.google.com/search?q=https://a.b")], schema("university_programs"))
    ap = spark.createDataFrame([("1", "Welder", "100"), ("2", "Arborist", "1"), ("3", None, None)], schema("apprenticeships"))
    mapping = spark.createDataFrame([("Building", ["47-2031"]), ("Academy", ["47-2031", "00-0000"]), ("Arch", []), ("Welder", ["47-2031"])], schema("program_code_map"))
    sources = [programs.community(cc, colleges), programs.initiatives(wi), programs.university(un), programs.apprenticeships(ap, "S", "u", ["Arborist"])]
    assert sources[2].first()["url"] == "https://a.b"
    out = programs.build_programs(sources, mapping, titles)
    assert [(r["soc_code"], r["program_name"], r["program_type"], r["college"]) for r in out.collect()] == [
        ("00-0000", "Academy", "bootcamp", "Workforce Initiative"), ("47-2031", "Welder", "apprenticeship", "S"),
        ("47-2031", "Building", "associate", "A B College"), ("47-2031", "Academy", "bootcamp", "Workforce Initiative"),
    ]
    assert [r["soc_code"] for r in programs.coverage(out, titles)["missing"].collect()] == ["47-9999"]


def test_employers(spark):
    titles = spark.createDataFrame([("a", "Job A"), ("b", "Job/B & C")], "soc_code string, occ_title string")
    raw = spark.createDataFrame(
        [(1, "General Contractors", " Big Builders "), (2, "Specialty Contractors", "Northern Roofing LLC"), (3, "Other", "No"), (4, "Specialty Contractors", "Unknown"), (5, "Specialty Contractors", None)],
        "ordinal long, agc_type string, employer_name string",
    )
    links = spark.createDataFrame([(1, "Northern Roof", "u1"), (2, "northern", "u2"), (3, "NORTHERN ROOF ", "u3"), (4, "x", None)], "ordinal long, company string, url string")
    codes = spark.createDataFrame([("Northern Roofing LLC", ["b"])], schema("code_cache"))
    boards = spark.createDataFrame([(1, "Board", None, ["b", "a"], "national"), (2, "Unknown", "site", ["a"], "national")], "ordinal long, board string, url string, soc_codes array<string>, scope string")
    full = F.array(F.lit("a"), F.lit("b"))
    members = employers.member_rows(employers.clean_members(raw), codes, full, employers.company_links(links), titles, "http://s?q=", "&l")
    out = employers.build_employers(members, employers.board_rows(boards, titles, "http://s?q=", "&l"))
    got = [(r["soc_code"], r["employer_name"], r["url"], r["url_type"]) for r in out.collect()]
    assert got == [
        ("a", "Board", "http://s?q=Job/B%20%26%20C&l", "job_board"), ("a", "Big Builders", "http://s?q=Job%20A&l", "indeed_fallback"),
        ("a", "Unknown", "http://s?q=Job%20A&l", "indeed_fallback"), ("b", "Board", "http://s?q=Job/B%20%26%20C&l", "job_board"),
        ("b", "Big Builders", "http://s?q=Job/B%20%26%20C&l", "indeed_fallback"), ("b", "Northern Roofing LLC", "u3", "company_site"),
        ("b", "Unknown", "http://s?q=Job/B%20%26%20C&l", "indeed_fallback"),
    ]
    assert {r["source_type"]: r["n"] for r in employers.counts(out).collect()} == {"job_board": 2, "local_employer": 5}
    assert employers.children_of(out, "a").first()["count"] == 3 and employers.children_of(out, "zz").count() == 0


def test_files(spark, tmp_path):
    sheet = tmp_path / "sheet.csv"
    sheet.write_text("title,,\nname,code,link\n" + "\n".join(f"n{i},11-90{i:02d},{'u' if i % 2 else ''}" for i in range(20)))
    landed = files.read_sheet(spark, str(sheet), ["name", "code", "url"], skip=2)
    assert [r["name"] for r in files.cell_range(landed, 3, 5, ["name"]).orderBy("ordinal").collect()] == ["n0", "n1", "n2"]
    assert files.with_links(landed).count() == 10
    (tmp_path / "map.json").write_text(json.dumps({"A, Inc": ["1", "2"], "B": []}, indent=2))
    codes = files.read_code_map(spark, str(tmp_path / "map.json"))
    assert sorted(tuple(r) for r in codes.collect()) == [("A, Inc", ["1", "2"]), ("B", [])]
    files.write_code_map(codes, str(tmp_path / "lines"))
    assert files.read_code_lines(spark, str(tmp_path / "lines")).exceptAll(codes).count() == 0
    df = spark.createDataFrame([("11-9021", 'say "hi", you\nthere', None)], "soc_code string, occ_title string, role_description string")
    files.write_csv(df, str(tmp_path / "csv"))
    back = files.read_csv(spark, str(tmp_path / "csv"), "occupations_raw")
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.collect()]
    assert files.labels_or_default(None, fixed.TOPIC_LABELS)[7] == "Supervision & Leadership"
    with pytest.raises(ValueError):
        require_columns(df, ["nope"])
    assert keep_existing(df, ["nope", "soc_code"]).columns == ["soc_code"]


def _skill_rows(spark, texts, key):
    return recommend.skill_lists(spark.createDataFrame(texts, f"{key} long, t string"), "t", [key])


def test_missing_skills_need_no_whole_lists(spark, monkeypatch):
    words = [c * n for n in range(5, 13) for c in "abcdefgh"]  # 64 skill words
    common, rare = " ".join(words), " ".join(words[20:])
    targets = [(0, common), (1, rare), (2, "welding pipes"), (3, None), (4, ""), (5, common), (5, "welding"), (6, " ".join(reversed(words)))]
    sources = [(10, common), (11, " ".join(words[24:])), (12, "pipes, only"), (13, None), (14, common + " welding"), (14, "welding")]
    pairs = [(q, o) for q in range(10, 15) for o in range(7)]
    first_words = spark.createDataFrame(targets, "ordinal long, t string").select("ordinal", text.skill_words(F.col("t")).alias("t"))
    source_words = spark.createDataFrame(sources, "query_id long, t string").select("query_id", text.words(F.col("t")).alias("s"))
    asked = spark.createDataFrame(pairs, "query_id long, ordinal long")
    plain = asked.join(first_words, "ordinal").join(source_words, "query_id").select("query_id", "ordinal", text.skill_gap(F.col("s"), F.col("t")))
    want = sorted((q, o, None if g is None else " ".join(g)) for q, o, g in plain.collect())
    whole = []
    written = recommend.cut_lineage

    def watched(df):
        out = written(df)
        if "_open" in df.columns:
            whole.extend(tuple(r) for r in out.where("_open").select("query_id", "ordinal").distinct().collect())
        return out

    lists = _skill_rows(spark, targets, "ordinal"), _skill_rows(spark, sources, "query_id")
    monkeypatch.setattr(recommend, "cut_lineage", watched)
    got = recommend.missing_skills(asked, *lists, ["query_id"]).collect()
    key = lambda r: (r[0], r[1], r[2] or "", r[2] is None)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert (10, 0) not in whole and (10, 6) not in whole  # like lists
    assert (12, 0) not in whole  # the head has enough
    assert (11, 0) in whole  # what is missing stands behind the head


def test_few_asked_codes_read_few_texts(spark):
    rows = spark.range(50).select("id", F.col("id").cast("string").alias("code"), F.lit("welding").alias("t"))
    asked = spark.createDataFrame([(3, "7"), (4, "7"), (4, "x")], "id long, code string")
    assert sorted(r[0] for r in recommend.skill_lists(rows, "t", ["id", "code"], asked).collect()) == [3, 4, 7]
    assert recommend.skill_lists(rows, "t", ["id"]).count() == 50


def test_support_of_some_occupations(spark, tmp_path):
    from catalog import advice

    lines = [(k, s, "2020-01-01") for k in (3, 3, 5, 7) for s in (1, 2)] + [(None, 1, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_shipdate string").write.parquet(f"{tmp_path}/lineitem.parquet")
    orders = [(1, 3), (2, 7), (4, 7), (5, 9), (6, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    of = spark.createDataFrame([(3,), (7,), (7,), (10**9,)], "ordinal long")
    some, every = advice._support(spark, str(tmp_path), of), advice._support(spark, str(tmp_path))
    want = sorted((r for r in every.collect() if r["soc_code"] in ("3", "7")), key=str)
    assert len(want) == 2 and sorted(some.collect(), key=str) == want
