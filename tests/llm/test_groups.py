"""Near duplicates, repeated passages, shards and fingerprints."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.llm import components, order_minhash, repeats, sharding, simhash
from tests.llm import brute


def test_near_groups_of_odd_rows(odd, odd_rows):
    got = simhash.near_groups(odd).collect()
    prints = [brute.simhash(r[1]) for r in odd_rows]
    root = brute.near_components(prints)
    least = {}
    for r, c in zip(odd_rows, root):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = Counter((r[0], p, least.get(c)) for r, p, c in zip(odd_rows, prints, root))
    assert Counter((r[0], r[1] % (1 << 64), r[2]) for r in got) == want


def test_links_split_large_cells(spark):
    rnd = random.Random(3)
    values = {rnd.getrandbits(64) for _ in range(200)}
    for center in list(values)[:6]:
        for _ in range(60):
            values.add(center ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    values = sorted(values)
    frame = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "value bigint")
    joined = components.components(simhash.links(frame, 2, group=8), "a", "b").collect()
    got = {}
    for node, root in joined:
        got.setdefault(root, set()).add(node % (1 << 64))
    want = {}
    for v, r in zip(values, brute.near_components(values)):
        want.setdefault(r, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


@pytest.mark.parametrize("budget", [0, 1, 3])
def test_trie_walk_finds_all_pairs(budget):
    rnd = random.Random(budget)
    runs = [sorted({(rnd.getrandbits(12) << 52) | rnd.getrandbits(6) for _ in range(90)}) for _ in range(3)]
    values = np.array([v for run in runs for v in run], np.uint64)
    begin = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    x, y = simhash.trie_links(values, begin, budget)
    got = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
    want = {
        (i, j) for s, e in zip(begin, begin[1:]) for i in range(s, e) for j in range(i + 1, e)
        if (int(values[i]) ^ int(values[j])).bit_count() <= budget
    }
    assert got == want and len(x) == len(want)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (300, 301), (301, 300)]
    got = components.components(spark.createDataFrame(links, "a bigint, b bigint"), "a", "b").collect()
    groups = {}
    for node, root in got:
        groups.setdefault(root, set()).add(node)
    assert sorted(map(len, groups.values())) == [2, 40, 51]
    assert components.components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_first_of_groups(odd, odd_rows, empty):
    kept = simhash.first_of_groups(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    prints = [brute.simhash(r[1]) for r in odd_rows]
    root = brute.near_components(prints)
    assert len(rows) == len(set(root))
    least = {}
    for r, c in zip(odd_rows, root):
        least[c] = min(least.get(c, (True, 0)), brute.order(r[0]))
    assert Counter(brute.order(r[0]) for r in rows) == Counter(least.values())
    assert simhash.first_of_groups(empty).count() == 0 and simhash.near_groups(empty).count() == 0


@pytest.mark.parametrize("scale", [repeats.Scale(), repeats.Scale(local=1, cell=2), repeats.Scale(length=12, gram=20, local=2)])
@pytest.mark.parametrize("whole", [False, True])
def test_repeats_of_odd_rows(odd, odd_rows, scale, whole):
    out = repeats.remove_repeats(odd.select("doc_id", "text", "_row"), scale=scale, whole_characters=whole)
    got = Counter((r._row.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in out.collect())
    assert got == Counter(brute.repeats([r[:2] for r in odd_rows], scale.length, whole))


def test_repeats_of_frequent_passages(spark):
    from tests.llm.conftest import prose

    line, passage = prose(50, 14), prose(51, 60)
    rows = [(i, f"{prose(100 + i, 6)} {line} {prose(300 + i, 5)}" + (f" {passage} end{i}" if i % 2 else "")) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for scale in (repeats.Scale(), repeats.Scale(local=2, cell=3)):
        got = {r._row.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), bytes(r.kept)) for r in repeats.remove_repeats(frame, scale=scale).collect()}
        assert got == {r[0]: r[1:] for r in brute.repeats(rows)}


def test_repeats_needs_an_integer_key(odd, empty):
    assert repeats.remove_repeats(empty).count() == 0
    with pytest.raises(TypeError):
        repeats.remove_repeats(odd, key="source")


def test_shards_keep_groups_whole_and_level(odd, odd_rows, empty):
    got = sharding.shards(odd, count=3).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    by_text = {}
    for r in got:
        by_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(v) == 1 for v in by_text.values())
    assert sharding.shards(empty, count=3).count() == 0
    with pytest.raises(ValueError):
        sharding.shards(odd)


def test_shards_of_a_capacity(spark):
    rows = [(i, "x" * (i % 37) + str(i)) for i in range(500)]
    got = sharding.shards(spark.createDataFrame(rows, "doc_id bigint, text string"), capacity=1200).collect()
    sums = Counter()
    for r in got:
        sums[r.shard] += r.size
    assert max(sums.values()) <= 1200 and len(sums) <= -(-sum(sums.values()) // 1200) + 1


def test_best_fit_decreasing_against_a_plain_version():
    rnd = random.Random(5)
    for _ in range(30):
        sizes = sorted((rnd.randint(1, 60) for _ in range(80)), reverse=True)
        rooms, want = [], []
        for s in sizes:
            fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
            i = min(fits)[1] if fits else len(rooms)
            if not fits:
                rooms.append(64)
            rooms[i] -= s
            want.append(i)
        assert sharding.best_fit_decreasing(sizes, 64) == (want, len(rooms))


def test_level_bins_with_an_oversized_item():
    bins = sharding.level_bins([1000] + [3] * 300, 4)
    sums = Counter()
    for b, s in zip(bins, [1000] + [3] * 300):
        sums[b] += s
    assert sums[bins[0]] == 1000 and sorted(sums.values())[:3] == [300, 300, 300]


def test_edited_texts(spark, odd, odd_rows, empty):
    from tests.llm.conftest import prose

    rows = [(i * 3, prose(i, 5 + i * 7)) for i in range(30)] + [(1, None), (2, ""), (500, "é")]
    got = {r.doc_id: r for r in order_minhash.edited_pairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for k, n, s in brute.edited(rows):
        assert (got[k].n_chars, got[k].edited_sha256) == (n, s)
    assert got[1].signature == got[2].signature == [0] * order_minhash.TUPLES
    out = order_minhash.edited_pairs(odd).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in out)
    assert order_minhash.edited_pairs(empty).count() == 0


def _signature(spark, texts):
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.s for r in order_minhash.with_signature(frame, "t", "s").orderBy("i").collect()]


def test_signature_against_a_plain_version(spark):
    """Least k-mers on the circle of hashes, numbered by occurrence, in text order."""
    from tests.llm.conftest import prose

    texts = [prose(9, 90), "a b c", "z " * 40 + prose(8, 20), prose(9, 90).replace("the", "teh")]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    words = frame.select("i", order_minhash.words_of(F.col("t")).alias("w"))
    kmers = {r.i: r.k for r in words.select("i", order_minhash._kmers(F.col("w"), order_minhash.K).alias("k")).collect()}
    got = _signature(spark, texts)
    spread = [(j << 39) // order_minhash.TUPLES for j in range(order_minhash.TUPLES)]
    for i, sig in enumerate(got):
        seen, items = Counter(), []
        for place, h in enumerate(kmers[i]):
            items.append((h, seen[h], place))
            seen[h] += 1
        again = spark.createDataFrame(items, "h bigint, o bigint, p int").select(
            F.when(F.col("o") == 0, F.col("h")).otherwise(F.xxhash64("h", F.col("o").cast("int"))).alias("x"), "p"
        ).collect()
        ranked = sorted(((r.x % (1 << 64)) >> 25, r.p) for r in again)
        pairs = []
        for m in spread:
            after = [r for r in ranked if r[0] >= m] + [r for r in ranked if r[0] < m]
            two = (after * 2)[:2]
            pairs.append([h for h, _ in sorted(two, key=lambda r: (r[1], r[0]))])
        want = [r.s for r in spark.createDataFrame([(j, p) for j, p in enumerate(pairs)], "j int, p array<bigint>").orderBy("j").select(
            F.xxhash64("p").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("s")).collect()]
        assert sig == want
    assert got[0] == _signature(spark, [texts[0]])[0]


def test_order_matters_to_a_signature(spark):
    words = [f"w{i}" for i in range(400)]
    turned = words[200:] + words[:200]
    same, other = _signature(spark, [" ".join(words), " ".join(turned)])
    alike = sum(a == b for a, b in zip(same, other)) / len(same)
    assert 0.2 < alike < 0.9  # nearly the same k-mers, in another order
