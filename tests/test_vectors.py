import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import blocks, density, forest, hierarchy, kmeans, mixture, silhouette, similarity, ward

D = 5


def points(n=90, seed=1, copies=True):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.4, (n // 3, D)) for c in (0.0, 1.5, 4.0)])
    if copies:  # a third of all rows is one vector
        x[: n // 3] = x[0]
    return x


def frame(spark, x, **columns):
    data = [(i, v.tolist(), float(10 * i), *[c[i] for c in columns.values()]) for i, v in enumerate(x)]
    extra = "".join(f", {name} int" for name in columns)
    return spark.createDataFrame(data, f"id long, vec array<double>, wage double{extra}").repartition(3)


PATHS = [{}, {"held_bytes": 0, "block_rows": 20}]


@pytest.mark.parametrize("limits", PATHS + [{"held_bytes": 60 * D * 8, "block_rows": 20}])
def test_neighbours(spark, limits):
    x = points()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(u @ u.T, 9)
    want = {i: [int(j) for j in np.lexsort((np.arange(len(x)), -sim[i]))[:4]] for i in range(len(x))}
    some = frame(spark, x).where("id < 50")
    got = {}
    for r in similarity.nearest(some, frame(spark, x), 4, D, query_id="id", ordinal="id", **limits).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["ordinal"])
    assert got == {i: want[i] for i in range(50)}


def test_pairs_are_shared_out_over_cores(spark, monkeypatch):
    one = frame(spark, points()).coalesce(1).select("id", "vec")

    def count(a, b):
        return a.select(["id"]).append_column("n", [[b.num_rows] * a.num_rows])

    monkeypatch.setattr(blocks, "TASK_CELLS", 1_000)
    met = blocks.all_against_all(one, one, "id", "id", D, count, "id BIGINT, n BIGINT")
    assert met.rdd.getNumPartitions() == 9 and sorted(tuple(r) for r in met.collect()) == [(i, 90) for i in range(90)]
    full = blocks.rows_per_block(64)
    assert blocks.block_count(full, blocks.rows_per_block(64, None, full, 12)) ** 2 >= 4 * 12
    assert blocks.rows_per_block(64, None, 1000 * full, 12) == full and blocks.rows_per_block(64, 20, full, 12) == 20


@pytest.mark.parametrize("limits", PATHS)
def test_rules(spark, limits):
    x = points(copies=False)
    n = len(x)
    wage, label, boundary = np.arange(n) * 10.0, np.arange(n) % 3, (np.arange(n) % 7) / 7
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cand = spark.createDataFrame(
        [(i, x[i].tolist(), float(wage[i]), float(boundary[i]), [int(label[i])]) for i in map(int, range(n))],
        "ordinal long, vec array<double>, wage double, boundary double, labels array<bigint>",
    )
    data, want = [], {}
    for i in range(n):
        for m, mode in enumerate(similarity.RULES):
            rule, q = similarity.RULES[mode], i * 4 + m
            ok = np.ones(n, bool)
            ok &= (wage > wage[i]) if rule.higher_pay_only else True
            ok &= (label != label[i]) if rule.other_group_only else True
            ok &= (np.arange(n) != i) if rule.exclude_self else True
            top = float(wage[ok].max()) if ok.any() else None
            floor = 300.0 if mode == "skill_match" else None
            ok &= (wage >= floor) if floor else True
            score = rule.similarity * (u @ u[i]) + rule.boundary * boundary + rule.same_group * (label == label[i])
            score = score + (rule.pay * wage / top if rule.pay and top else 0)
            order = [int(j) for j in np.lexsort((np.arange(n), -np.round(score, 9))) if ok[j]][:5]
            if order:
                want[q] = order
            data.append((q, mode, x[i].tolist(), i, float(wage[i]), floor, top, 0, int(label[i])))
    queries = spark.createDataFrame(
        data, "query_id long, mode string, vec array<double>, self long, wage double, min_wage double, max_wage double, method long, label long"
    )
    got = {}
    for r in similarity.rank_candidates(queries, cand, 5, D, **limits).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["ordinal"])
    assert got == want


@pytest.mark.parametrize("limits", PATHS + [{"held_bytes": 0, "block_rows": 35}])
def test_silhouette(spark, limits):
    x = points(copies=False)
    label = [0] * 60 + [1] * 20 + [2] * 8 + [3] + [-1]
    keep = [i for i, l in enumerate(label) if l != -1]
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in keep:
        mean = {l: np.mean([dist[i, j] for j in keep if label[j] == l and j != i] or [np.nan]) for l in set(label) - {-1}}
        a, b = mean[label[i]], min(v for l, v in mean.items() if l != label[i])
        s.append(0.0 if label.count(label[i]) == 1 else (b - a) / max(a, b))
    df = frame(spark, x, l=label)
    assert silhouette.silhouette_score(df, "id", "vec", "l", D, **limits) == round(float(np.mean(s)), 4)
    more = df.withColumn("m", (F.col("id") % 3).cast("int")).withColumn("one", F.lit(1))
    got = silhouette.silhouette_scores(more, "id", "vec", ["l", "m", "one"], D, **limits)
    alone = silhouette.silhouette_score(more, "id", "vec", "m", D)
    assert got == {"l": round(float(np.mean(s)), 4), "m": alone, "one": -1.0}
    assert silhouette.silhouette_scores(more, "id", "vec", ["l", "m"], D, few=3, **limits) == {"l": got["l"], "m": alone}


def test_silhouette_needs_two_groups(spark):
    df = frame(spark, points(), l=[0] * 90)
    assert silhouette.silhouette_score(df, "id", "vec", "l", D) == -1.0


def brute_ward(x):
    groups, merges = {i: [i] for i in range(len(x))}, []
    while len(groups) > 1:
        best = None
        for a in groups:
            for b in groups:
                if a < b:
                    na, nb = len(groups[a]), len(groups[b])
                    d = x[groups[a]].mean(0) - x[groups[b]].mean(0)
                    h = np.sqrt(2 * na * nb / (na + nb) * (d @ d))
                    if best is None or h < best[0] - 1e-12:
                        best = (h, a, b)
        h, a, b = best
        groups[a] += groups.pop(b)
        merges.append((h, len(groups[a])))
        if len(groups) <= 5:
            yield len(groups), {frozenset(g) for g in groups.values()}
    yield 0, sorted(h for h, _ in merges)


@pytest.mark.parametrize("few,limits", [(500, {}), (10, {}), (10, {"held_bytes": 0, "block_rows": 20})])
def test_ward_is_exact(spark, few, limits):
    x = points(60)
    want = dict(brute_ward(x))
    df = frame(spark, x)
    merges = ward.ward_merges(df, "id", "vec", D, few, **limits)
    got = merges.collect()
    assert len(got) == len(x) - 1 and max(r["size"] for r in got) == len(x)
    np.testing.assert_allclose(sorted(r["distance"] for r in got), want[0], atol=1e-6)
    cut = ward.cut_tree(merges, df.select(F.col("id").alias("node")), (3, 4, 5), small=few)
    for k in (3, 4, 5):
        parts = {}
        for r in cut.collect():
            parts.setdefault(r[f"k{k}"], set()).add(r["node"])
        assert {frozenset(p) for p in parts.values()} == want[k]


def brute_density(x, min_size, min_samples):
    """Textbook top-down reading: split components at every edge removal, keep the stablest."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, min_samples]
    reach = np.maximum(d, np.maximum(core[:, None], core[None]))
    edges = []
    order = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for w, i, j in order:
        a, b = find(i), find(j)
        if a != b:
            root[b] = a
            edges.append((w, i, j))

    def parts(members, kept):
        out, left = [], set(members)
        while left:
            stack, seen = [left.pop()], set()
            while stack:
                v = stack.pop()
                seen.add(v)
                for _, i, j in kept:
                    for s, t in ((i, j), (j, i)):
                        if s == v and t in left:
                            left.discard(t)
                            stack.append(t)
            out.append(seen)
        return out

    def best(members, kept, birth, top):
        full = set(members)
        node_members, k = set(members), list(kept)
        stability = 0.0
        while True:
            w, i, j = k.pop()
            level = 1 / max(w, 1e-12)
            a, b = parts(node_members, [e for e in k if e[1] in node_members])
            big = [p for p in (a, b) if len(p) >= min_size]
            if len(big) == 1:
                stability += (len(node_members) - len(big[0])) * (level - birth)
                node_members, k = big[0], [e for e in k if e[1] in big[0]]
                continue
            stability += len(node_members) * (level - birth)
            below = [best(p, [e for e in k if e[1] in p], level, False) for p in big]
            total = sum(s for s, _ in below)
            if not top and stability >= total:
                return stability, [frozenset(full)]
            return total, [c for _, cs in below for c in cs]

    return set(best(set(range(n)), sorted(edges), 0.0, True)[1])


@pytest.mark.parametrize("min_size,args", [(2, {}), (4, {}), (4, {"stretch": 7, "small": 3}), (3, {"stretch": 11, "held_bytes": 0, "block_rows": 20})])
def test_density_is_exact(spark, min_size, args):
    x = points(45, seed=4, copies=False)
    want = brute_density(x, min_size, 2)
    limits = {k: v for k, v in args.items() if k in ("held_bytes", "block_rows")}
    small = args.get("small", forest.SMALL)
    df = frame(spark, x)
    tree = density.reachability_tree(df, "id", "vec", D, 2, small=small, **limits)
    assert tree.count() == len(x) - 1
    labels = density.condensed_clusters(
        df.select(F.col("id").alias("key")), tree, min_size, args.get("stretch", density.STRETCH), small
    )
    got = {}
    for r in labels.collect():
        got.setdefault(r["label"], set()).add(r["key"])
    got.pop(-1, None)
    assert {frozenset(g) for g in got.values()} == want


def test_density_with_many_copies(spark):
    labels, info = density.density_clusters(frame(spark, points()), "id", "vec", "wage", D)
    assert labels.count() == 90 and info["n_clusters"] >= 1
    one = {r["cluster_hdbscan"] for r in labels.where("id < 30").collect()}
    assert len(one) == 1


def test_stable_clusters_both_ways(spark):
    """Rounds over chains, bushes and random trees choose as one pass from the leaves does."""
    rng = np.random.default_rng(5)
    rows, free = [], []
    for node in range(120):  # two finished nodes meet in the next, or a new leaf begins
        if len(free) > 1 and rng.random() < 0.6:
            for child in (free.pop(), free.pop(rng.integers(len(free)) if rng.random() < 0.3 else -1)):
                rows[child][1] = node
        rows.append([node, None, float(rng.integers(0, 9))])
        free.append(node)
    chain = [[1000 + i, 1000 + i + 2 - i % 2 if i < 78 else None, float(rng.integers(0, 30))] for i in range(80)]
    clusters = spark.createDataFrame(rows + chain, "node BIGINT, parent BIGINT, stability DOUBLE")
    one, other = (sorted(map(tuple, hierarchy.stable(clusters, small).collect())) for small in (1000, 3))
    assert one == other and sum(r[2] for r in one) > 20


@pytest.mark.parametrize("stretch", [density.STRETCH, 4])
def test_clusters_of_equal_edges_are_kept(spark, stretch):
    """All edges weigh the same: two clusters of stability zero, whatever their sums round to."""
    groups = [{0, 1, 2, 3, 4, 100}, {10, 11, 12, 13, 14, 101}]  # the edge between the hubs 100 and 101 comes last
    edges = [(k, max(g), 0.07) for g in groups for k in sorted(g) if k < 100] + [(100, 101, 0.07)]
    tree = spark.createDataFrame(edges, "lo long, hi long, w double")
    keys = spark.createDataFrame([(k,) for g in groups for k in g], "key long")
    got = {}
    for r in hierarchy.condensed_clusters(keys, tree, 2, stretch).collect():
        got.setdefault(r["label"], set()).add(r["key"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups)) and -1 not in got


@pytest.mark.parametrize("small", [1000, 2])
def test_equal_stabilities_choose_the_parent(spark, small):
    """0.1 + 0.2 is as much as 0.3."""
    clusters = spark.createDataFrame([(0, 2, 0.1), (1, 2, 0.2), (2, 4, 0.3), (3, 4, 0.0), (4, None, 9.0)], "node long, parent long, stability double")
    marked = {r["node"]: r["marked"] for r in hierarchy.stable(clusters, small).collect()}
    assert marked[2] and not marked[4]


def test_forest_both_ways(spark):
    links = [(i, i // 2) for i in range(1, 64)]
    tree = [(i, i // 2 if i > 1 else None, i in (5, 11, 3)) for i in range(1, 64)]

    def top(i):
        best = None
        while i:
            best, i = (i if i in (5, 11, 3) else best), i // 2
        return best

    for small in (1000, 2):
        df = spark.createDataFrame(links, "node long, parent long")
        assert {tuple(r) for r in forest.roots(df, small).select("node", "root").collect()} == {(i, 0) for i in range(1, 64)}
        t = spark.createDataFrame(tree, "node long, parent long, marked boolean")
        assert {tuple(r) for r in forest.topmost(t, small).select("node", "top").collect()} == {(i, top(i)) for i in range(1, 64)}


@pytest.mark.parametrize("sweep", [kmeans.kmeans_sweep, mixture.mixture_sweep, ward.ward_sweep])
def test_labels_climb_with_pay(spark, sweep):
    df = frame(spark, points(copies=False)).persist()
    labels, info = sweep(df, "id", "vec", "wage", D)
    name = labels.columns[1]
    medians = [r[1] for r in labels.join(df, "id").groupBy(name).agg(F.median("wage")).orderBy(name).collect()]
    assert labels.count() == 90 and medians == sorted(medians) and len(medians) == info["n_clusters"]
    assert -1 <= info["silhouette"] <= 1
    if "membership" in labels.columns:
        for r in labels.collect():
            assert abs(sum(r["membership"]) - 1) < 1e-9


def test_mixture_recovers_groups(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in (0.0, 3.0, 9.0)])
    df = frame(spark, x).select("id", "vec")
    start = {0: np.array([[0.5, 0.5], [2.0, 2.0], [8.0, 8.0]])}
    model, _ = mixture.fit_mixtures(df, start, 2, 180)[0]
    np.testing.assert_allclose(sorted(model.means[:, 0]), [0, 3, 9], atol=0.2)
    np.testing.assert_allclose(model.weights, [1 / 3] * 3, atol=1e-3)


def test_criterion():
    assert mixture.better(-200.0, 0.1, -100.0, 0.5) and mixture.better(98.0, 0.1, 100.0, 0.5)
    assert not mixture.better(99.5, 0.1, 100.0, 0.5) and mixture.better(-99.5, 0.1, -100.0, 0.5)
    assert not mixture.better(-99.5, 0.1, -100.0, 0.5, by_size=True)
    assert mixture.better(-99.5, 0.6, -100.0, 0.5)
    assert not mixture.better(-90.0, 0.9, -100.0, 0.5)


def test_ward_rounds_keep_a_flat_size_estimate(spark, monkeypatch, capsys):
    """State that is read back has its own size, so estimates do not multiply from round to round."""
    from gradus.operators import ward

    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(260, 3)).cumsum(axis=0))]
    sizes, plain = [], ward.cut_lineage

    def watched(frame):
        out = plain(frame)
        sizes.append(int(str(out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())))
        return out

    monkeypatch.setattr(ward, "cut_lineage", watched)
    merges = ward.ward_merges(spark.createDataFrame(rows, "id BIGINT, v ARRAY<DOUBLE>"), "id", "v", 3, few=4)
    assert merges.count() == 259
    rounds = (len(sizes) - 1) // 3
    with capsys.disabled():
        print(f" {rounds} rounds", end="")
    assert rounds >= 5 and max(sizes) < 1 << 20


def test_neighbours_in_blocks_around_pivots(spark):
    """Clusters of unlike sizes, copies and zero rows: the same neighbours as by brute force, from under half of all block pairs."""
    from gradus.operators import pivots

    rng = np.random.default_rng(11)
    centers = rng.normal(size=(8, 12))
    x = np.concatenate([c + rng.normal(scale=0.02, size=(n, 12)) for c, n in zip(centers, (90, 5, 40, 30, 20, 60, 25, 28))] + [np.zeros((2, 12))])
    x[10:50] = x[10]
    u = x / np.where(x.any(1), np.linalg.norm(x, axis=1), 1)[:, None]
    sim = np.round(u @ u.T, 9)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id BIGINT, vec ARRAY<DOUBLE>").repartition(3)
    got = {}
    for r in similarity.knn_graph(df, "id", "vec", 12, k=7, held_bytes=0, block_rows=15).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == {i: [int(j) for j in np.lexsort((np.arange(len(x)), -sim[i]))[:7]] for i in range(len(x))}
    asking, there = df.withColumnRenamed("id", "query_id"), df.withColumnRenamed("id", "ordinal")
    left, right, pairs = pivots.near_blocks(asking, there, 7, len(x), 12, 0, 15)
    every = left.select("own", "turn").distinct().count() * right.select("cell", "piece").distinct().count()
    assert pairs.count() < 0.5 * every


def test_starts_are_drawn_from_all_rows(spark):
    """A group of one row in ten thousand gets a center, rows far from all centers being likelier."""
    rng = np.random.default_rng(2)
    x = rng.normal(scale=0.01, size=(10_000, 3))
    x[7777] = 50.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id BIGINT, vec ARRAY<DOUBLE>").repartition(5)
    asked = [(2, seed) for seed in range(6)] + [(4, 9)]
    starts = kmeans.spread_starts(df, "id", "vec", asked)
    assert all((s == 50.0).all(axis=1).any() for s in starts) and [len(s) for s in starts] == [k for k, _ in asked]
    assert all(len(np.unique(s, axis=0)) == len(s) and (s[:, None] == x[None]).all(2).any(1).all() for s in starts)
    again = kmeans.spread_starts(df.repartition(2), "id", "vec", asked)
    assert all(np.array_equal(a, b) for a, b in zip(starts, again)) and len({tuple(s[0]) for s in starts}) > 3
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id BIGINT, vec ARRAY<DOUBLE>")
    assert kmeans.spread_starts(same, "id", "vec", [(3, 1)])[0].tolist() == [[1.0, 2.0]] * 3
