"""Token files: exact round trips, and the registered query against the library."""

import os
import random
import zlib

import numpy as np
import pytest

from gradus.llm import common, token_files

SF = "/root/testdata/sf0.001"


def _library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _ids(texts):
    return [[*e.ids, 1] for e in _library().encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _sequences():
    rnd = np.random.default_rng(1)
    words = [rnd.integers(0, 49_000, rnd.integers(1, 9)) for _ in range(60)]
    yield np.zeros(0, np.uint32)
    yield np.array([7], np.uint32)
    yield np.full(5001, 3, np.uint32)
    yield np.tile(np.arange(700), 40).astype(np.uint32)
    yield np.tile([1, 2], 999).astype(np.uint32)
    yield np.concatenate([words[i] for i in rnd.integers(0, 60, 4000)]).astype(np.uint32)
    yield rnd.integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32)
    yield rnd.integers(0, 3, 20_000).astype(np.uint32)


def test_blocks_give_back_ids_from_any_place():
    rnd = random.Random(2)
    for ids in _sequences():
        for least in (2, 32):
            block = token_files.Block(token_files.packed(ids, least))
            assert block.n == len(ids) and np.array_equal(block.ids(), ids)
            for _ in range(20):
                a, b = sorted((rnd.randint(0, len(ids)), rnd.randint(0, len(ids))))
                assert np.array_equal(block.ids(a, b), ids[a:b])


def test_grammar_has_frequent_pairs_of_earlier_symbols_and_exact_lengths():
    for ids in _sequences():
        alphabet, rules, body = token_files.paired(ids, 16)
        whole = [[int(x)] for x in alphabet]
        for a, b in rules.tolist():
            whole.append(whole[a] + whole[b])
        assert [x for s in body.tolist() for x in whole[s]] == ids.tolist()
        assert token_files._lengths(rules, len(alphabet)).tolist() == [len(w) for w in whole[len(alphabet) :]]
        assert set(range(len(alphabet) + len(rules))) == {*body.tolist(), *rules.ravel().tolist()}
        assert len(set(map(tuple, rules.tolist()))) == len(rules)
        pairs, times = np.unique(body[:-1].astype(np.int64) << 32 | body[1:], return_counts=True)
        alike = pairs >> 32 == pairs & 0xFFFFFFFF  # overlapping occurrences count half
        assert (times[~alike] < 16).all()
    repeated = np.tile(np.arange(700), 400).astype(np.uint32)
    assert len(token_files.packed(repeated)) < len(repeated) / 10


def test_encoding_equals_the_library(odd_rows):
    import pyarrow as pa

    texts = [r[1] or "" for r in odd_rows] + [
        "it's, we'll. DON'T!and,'s x.y,z a:'re ok;'ve", "H̱ ẖ, Á.B <|endoftext|>,<|startoftext|>.a <|ENDOFTEXT|>", "a b c,d\u0085e", ",.;:!? a, .b",
        "ÀÉ,ß.ŁÓdź! Ⅻ,½.x", "x" * 3000 + "," + "y" * 50,
    ]
    want = _ids(texts)
    for _ in range(2):
        ids, at = token_files.encoded(pa.array(texts), "word_bpe_49k.json")
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == want
    ids, at = token_files.encoded(pa.array(texts), "word_bpe_49k.json", end=None)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [w[:-1] for w in want]


def test_files_of_odd_rows(spark, odd, odd_rows):
    folder = common.shared_folder(spark)
    token_files.write_ids(odd, folder, block_ids=500, least=4, parts=3)
    got = sorted(token_files.read_ids(spark, folder).collect(), key=lambda r: r.start)
    texts = [(r[0], r[1] or "") for r in odd_rows]
    want = {}
    for (k, t), ids in zip(texts, _ids([t for _, t in texts])):
        want.setdefault(k, []).append(ids)
    before = 0
    keys = [r.key for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(got) == len(odd_rows)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        want[r.key].remove(ids)
        assert r.start == before and r.n_tokens == len(ids)
        before += len(ids)
    shards = spark.read.parquet(folder).collect()
    assert len(shards) > 5 and max(len(list(token_files.blocks(s.image))) for s in shards) > 1
    assert all(b.n <= 500 for s in shards for b in token_files.blocks(s.image))


def test_empty_table(spark, empty):
    folder = common.shared_folder(spark)
    token_files.write_ids(empty, folder)
    assert token_files.read_ids(spark, folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")
def test_query(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    want, before = {}, 0
    for (k, _), ids in zip(rows, _ids([t for _, t in rows])):
        want[k] = (before, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    got = token_files.op12_token_files(spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == len(rows)
