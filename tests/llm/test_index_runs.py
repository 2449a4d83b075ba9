"""Three and more batches with compaction, and an index that is opened again, give what one batch gives."""

import random

from pairlytics.llm import substring_dedup
from pairlytics.llm.common import shared_dir


def test_batches_and_reopening(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    passages = [" ".join(rng.choices(vocab, k=30)) for _ in range(4)]
    text = lambda: " ".join([*rng.choices(vocab, k=40), rng.choice(passages), *rng.choices(vocab, k=20)])
    rows = [(i, text()) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)] + [(101, rows[1][1]), (None, rows[2][1]), (200, None), (201, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lambda out: sorted([tuple(r) for r in out.collect()], key=str)
    want = got(substring_dedup.deduplicate(df, 1))
    assert sum(r[2] for r in want) > 0
    index = substring_dedup.FingerprintIndex(spark, max_runs=2)
    assert got(substring_dedup.deduplicate(df, 5, index)) == want
    assert len(index.runs) == 1
    old, new = df.where("doc_id < 50"), df.where("doc_id >= 50 OR doc_id IS NULL")
    path = f"{shared_dir(spark)}/reopened"
    first = got(substring_dedup.deduplicate(old, 2, substring_dedup.FingerprintIndex(spark, path)))
    again = substring_dedup.FingerprintIndex(spark, path)
    assert len(again.runs) == 2
    assert sorted(first + got(substring_dedup.deduplicate(new, 2, again, old)), key=str) == want
