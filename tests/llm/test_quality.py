from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import functions as F

from gleaner.llm import decision_list as dl
from gleaner.llm.queries import QUERIES
from tests.llm.cases import WORD, documents, empty


def by_hand(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_query_against_hand_count(spark, folder):
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op4_quality_rules"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts = by_hand(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        assert not (r.base_failed and r.kept)
    labels = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect())
    judged = [(labels[r.doc_id], r.kept) for r in rows if r.doc_id in labels and not r.base_failed]
    assert all(kept for label, kept in judged if label == 1)


def test_edge_rows(spark):
    rows = dl.judge(documents(spark), []).collect()
    assert len(rows) == 16
    for r in rows:
        q = r._quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == by_hand(r.text)
        assert r._r in ("r", None)
    assert dl.judge(empty(spark), []).count() == 0


def test_repeats_that_overlap(spark):
    texts = ["a b c d e f g h a b c d e f g h", "a " * 30, "a b c d e f g h x b c d e f g h i", "p q " * 4 + "p q r s t u v w " * 2]
    for r in dl.judge(documents(spark, texts), []).collect():
        assert r._quality.n_repeat_words == by_hand(r.text)[4]


def test_learned_list_finds_the_planted_rule():
    rows = [({f: 0.1 for f in dl.FEATURES} | {"symbol_share": k / 100, "upper_share": (k * 7 % 10) / 10}, k >= 60) for k in range(100)] * 3
    rules = dl.learn(rows)
    assert len(rules) == 1 and rules[0].conditions[0][0] == "symbol_share"
    assert 0.59 <= rules[0].conditions[0][2] <= 0.6
    assert all(rules[0].covers(r) == bad for r, bad in rows)


def test_list_is_empty_without_two_kinds():
    row = {f: 0.5 for f in dl.FEATURES}
    assert dl.learn([]) == [] and dl.learn([(row, True)] * 9) == [] and dl.learn([(row, False)] * 9) == []


def test_rules_apply_in_order(spark):
    rules = [dl.Rule((("symbol_share", True, 0.5),)), dl.Rule((("mark_share", True, 0.2), ("symbol_share", False, 0.5)))]
    clean = " ".join(f"word{k}" for k in range(30))
    texts = [clean, clean + " #" * 80 + " !" * 40, clean + " !" * 20]
    fired = {r.doc_id: r._quality for r in dl.judge(documents(spark, texts), rules).filter(F.col("doc_id").isNotNull()).collect()}
    assert [fired[k].rule for k in (1, 2, 3)] == [0, 1, 2]
    assert [fired[k].kept for k in (1, 2, 3)] == [True, False, False]
