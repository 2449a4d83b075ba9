"""Packing of op4's n-grams: more buckets and shorter rows don't change a score."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pairlytics.llm import lm_score


def test_many_buckets(spark, docs, monkeypatch):
    want = sorted(lm_score.score(docs).collect(), key=str)
    monkeypatch.setattr(lm_score, "BUCKET_ENTRIES", 512)
    assert sorted(lm_score.score(docs).collect(), key=str) == want


def test_bucket_counts(monkeypatch):
    monkeypatch.setattr(lm_score, "ROW_ENTRIES", 2)
    rng, want, rows = np.random.default_rng(1), {}, []
    for block in (7, 9, 1 << 40):
        h = np.unique(rng.integers(0, 40, 25, dtype=np.uint64) << np.uint64(57))
        m = rng.integers(1, 1 << 40, len(h))
        for x, n in zip(h.tolist(), m.tolist(), strict=True):
            want.setdefault(x, {})[block] = n
        rows += lm_score._rows(block, h, m, 3)
    t = pa.Table.from_batches(rows)
    assert max(len(x.as_py()) for x in t["h"]) == 16
    got = {}
    for bucket in set(t["bucket"].to_pylist()):
        back = lm_score._merged(t.filter(pc.equal(t["bucket"], bucket)))
        for block, h, c in zip(*(back.column(x).to_pylist() for x in ("block", "h", "c")), strict=True):
            for x, n in zip(np.frombuffer(h, np.uint64).tolist(), np.frombuffer(c, np.int64).tolist(), strict=True):
                assert (block, x) not in got
                got[block, x] = n
    assert got == {(b, x): sum(of.values()) for x, of in want.items() if len(of) > 1 for b in of}
