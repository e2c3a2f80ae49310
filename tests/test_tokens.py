"""Token vectors in parts, truncation ahead of the model, rejected rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqflow.functions import sequences as S
from seqflow.operators.embed import composition_model, embed_tokens, letter_model, pool_parts
from seqflow.plans.embedding_job import embedding_job, rejected_rows, token_job

SEQS = [("a", 1, "ACD"), ("a", 2, ""), ("b", 3, "W" * 50), (None, 4, "ACDEFGHIKL" * 3), ("b", 5, "Y" * 200)]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(SEQS, "lane string, id long, seq string")


@pytest.mark.parametrize("part_bytes", [1, 4 * 8 * 7, 1 << 20])
def test_parts_join_to_whole_outputs(spark, seqs, part_bytes):
    rows = token_job(seqs, 100, ["lane"], "id", part_bytes=part_bytes, max_tokens=40)
    model = letter_model()
    got = {}
    for r in sorted(rows.collect(), key=lambda r: (r.id, r.part)):
        assert len(r.vectors) <= max(1, part_bytes // 32) and r.start == len(got.setdefault(r.id, []))
        got[r.id] += [list(v) for v in r.vectors]
    want = {i: model(np.array([s[:38]], dtype=object))[0].tolist() for _, i, s in SEQS if 0 < len(s) <= 100}
    assert got == want and len(got[3]) == 39  # without the start token, with the end token
    pooled = {r.id: (r.n_rows, r.embedding) for r in pool_parts(rows, ["id"]).collect()}
    for i, v in want.items():
        assert pooled[i][0] == len(v) and pooled[i][1] == pytest.approx(np.mean(v, axis=0).tolist())


def test_record_batches_stay_small(spark, monkeypatch):
    import pyarrow as pa
    from seqflow.operators import embed as E
    monkeypatch.setattr(E, "OUT_BYTES", 4000)
    t = pa.table({"batch_no": pa.array([0] * 5), "id": pa.array(range(5))})
    outputs = [np.ones((n, 4)) * n for n in (300, 0, 5, 40, 900)]
    batches = list(E._token_parts(t, ["batch_no", "id"], outputs, 1600))
    assert max(b.nbytes for b in batches) < 8000 and len(batches) > 5
    rows = [r for b in batches for r in b.to_pylist()]
    assert [sum(len(r["vectors"]) for r in rows if r["id"] == i) for i in range(5)] == [300, 0, 5, 40, 900]


def test_the_model_sees_no_more_than_its_tokens(spark, seqs):
    def lengths():
        return lambda s: np.array([[float(len(x))] for x in s])
    stored = embedding_job(seqs, 100, ["lane"], "id", make_predict_fn=lengths, max_tokens=32)
    assert {r.id: (r.embedding, r.n_tokens) for r in stored.collect()} == {1: ([3.0], 5), 3: ([30.0], 32), 4: ([30.0], 32)}


def test_rejected_rows_have_a_reason(spark, seqs):
    more = seqs.unionByName(spark.createDataFrame([("c", 9, None)], seqs.schema))
    got = {r.id: (r.n, r.reason) for r in rejected_rows(more, 100, ["id"]).collect()}
    assert got == {2: (0, "empty"), 5: (200, "oversize"), 9: (None, "null")}
    assert composition_model()(np.array(["AC"], dtype=object)).shape == (1, 20)
    assert embed_tokens(more.limit(0).withColumn("batch_no", F.lit(0)), ["lane"], "id").count() == 0
    assert S.MAX_TOKENS == 1024


def test_token_vectors_are_written_as_they_come(spark, seqs):
    """Folders would sort all vectors by folder ahead of the write."""
    stored = token_job(seqs, 100, ["lane"], "id", max_tokens=40)
    assert stored.count() and not any("batch_group=" in f for f in stored.inputFiles())
