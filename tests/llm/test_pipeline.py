"""Every stage of the pipeline on its own input against a plain version, and the registered queries against SQL."""

import os
from collections import Counter

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from gradus.llm import common, mixing
from tests.llm import brute
from tests.oracle import connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not here")


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of every stage."""
    docs, out = common.documents(spark, SF), {}
    for name, stage in corpus_pipeline.STAGES:
        done = common.written(stage(spark, docs, SF))
        out[name], docs = (docs.collect(), done.collect()), done
    return out


def _rows(rows):
    return Counter(tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in rows)


def test_quality_rules(stages):
    before, after = stages["quality rules"]
    passed = {r.doc_id for r in before if not brute.line_counts(r.text)[5]}
    kept = {r.doc_id: r for r in after}
    assert set(kept) <= passed and len(kept) > 0.8 * len(passed)
    for r in before:
        if r.doc_id in kept:
            lines = r.text.split("\n")
            at = iter(lines)
            assert all(line in at for line in kept[r.doc_id].text.split("\n"))  # lines go, none is changed
            assert kept[r.doc_id].n_chars == len(kept[r.doc_id].text)


def test_clean_documents_stay(spark, stages):
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    before, after = stages["quality rules"]
    clean = [r.doc_id for r in before if r.doc_id in good and not brute.line_counts(r.text)[5]]
    kept = {r.doc_id for r in after}
    assert sum(d in kept for d in clean) >= 0.98 * len(clean)


def test_near_duplicates(stages):
    before, after = stages["near duplicates"]
    root = brute.near_components([brute.simhash(r.text) for r in before])
    first = {}
    for r, c in zip(before, root):
        if c not in first or r.doc_id < first[c].doc_id:
            first[c] = r
    assert _rows(after) == _rows(first.values())


def test_repeated_passages(stages):
    before, after = stages["repeated passages"]
    want = {k: kept.decode() for k, _, _, _, kept in brute.repeats([(r.doc_id, r.text) for r in before], 50, True)}
    assert {r.doc_id: r.text for r in after} == want
    assert len(after) == len(before) and all(r.n_chars == len(r.text) for r in after)


def test_mixture(spark, stages):
    before, after = stages["mixture"]
    con = connect(SF)
    con.register("kept", spark.createDataFrame(before).toPandas())
    want = Counter(con.execute("with " + mixing.mixed_sql("kept", "")).fetchall())
    assert _rows(after) == want and set(want) <= set(_rows(before))


def test_tokens(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages["tokens"]
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in before:
        ids = whole.encode(r.text, add_special_tokens=False).ids
        decoded = whole.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(decoded.encode())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in after) == want


def test_run_gives_the_last_stage(spark, stages):
    got = Counter(map(tuple, entry.queries()["pipeline"](spark, SF).collect()))
    assert got == Counter(map(tuple, stages["tokens"][1]))


def test_stages_of_an_empty_table(spark):
    docs = common.documents(spark, SF).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF))
        assert docs.count() == 0


def test_stages_of_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF))
        if name == "quality rules":
            docs = odd  # most odd rows are too short for it
        elif name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS and docs.count() > 0
