"""The package reaches workers that were started elsewhere, and a word in every text is split."""

from __future__ import annotations

import os
import subprocess
import sys

from gleaner.operators import novelty

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from gleaner.session import build_session
from gleaner.plans import QUERIES
spark = build_session("elsewhere", 2, shuffle_partitions="2")
for name in ("min_dist_euclid", "greedy_kcenter", "stream_forgetting"):
    assert QUERIES[name](spark, {folder!r}).count() > 0, name
print("all ran")
"""


def test_queries_run_from_another_folder(tmp_path, folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = tmp_path / "run.py"
    script.write_text(SCRIPT.format(root=ROOT, folder=folder))
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]


def test_a_word_of_every_text_is_split(spark):
    conf = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        texts = spark.range(4000).selectExpr("id AS doc_id", "concat('the w', id % 40) AS text").repartition(6)
        scored = novelty.unigram_perplexity(texts)
        rows = scored.collect()
        assert len(rows) == 4000 and all(r.n_words == 2 for r in rows)
        assert "skew=true" in scored._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
