from __future__ import annotations

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleaner.llm import patched_blocks as pb
from gleaner.llm.queries import QUERIES, TOKENIZER
from gleaner.llm.tokens import encoder
from gleaner.session import scratch_path
from tests.llm.cases import documents, empty


def library(text):
    return encoder(TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids


NUMBERS = st.one_of(st.integers(-(2**63), 2**63 - 1), st.integers(0, 50_000), st.integers(0, 3))


@settings(max_examples=150, deadline=None)
@given(st.lists(NUMBERS, min_size=1, max_size=60), st.sampled_from([(1.0,), (0.5,), pb.PERCENTILES]))
def test_blocks_come_back(values, percentiles):
    block = pb.pack(np.array([values], dtype=np.int64), percentiles)
    assert pb.unpack(block).tolist() == values


def test_width_follows_the_percentile_and_outliers_are_patched():
    values = np.full((1, pb.BLOCK), 1000, dtype=np.int64) + np.arange(pb.BLOCK) % 16
    values[0, 7], values[0, 900] = 49_000, 1 << 60
    block = pb.pack(values)[0]
    low, n, more, width = pb.HEAD.unpack_from(block)
    assert (low, n, more, width) == (1000, pb.BLOCK, 2, 4 | 128)  # the top bit: upper bits need 64
    assert len(block) == pb.HEAD.size + pb.BLOCK * 4 // 8 + 2 * (2 + 8)
    assert (pb.unpack([block]) == values[0]).all()
    assert pb.HEAD.unpack_from(pb.pack(values, (1.0,))[0])[3] == 60  # the whole range instead


def test_file_and_random_access():
    rng = np.random.default_rng(3)
    docs = [(None, rng.integers(0, 49_408, 5))] + [
        (k * 3, np.minimum(rng.zipf(1.3, rng.integers(0, 9_000)), 49_407)) for k in range(60)
    ]
    out = io.BytesIO()
    w = pb.Writer(out)
    for k, x in docs:
        w.add([k], [x])
    size = w.close()
    assert size == len(out.getvalue())
    r = pb.Reader(io.BytesIO(out.getvalue()), size)
    whole = np.concatenate([x for _, x in docs])
    assert r.n_tokens == len(whole) and size < 2 * len(whole)
    for a, b in [(0, 1), (1023, 1025), (5, len(whole)), (len(whole) - 1, len(whole) + 50), (9, 9)]:
        assert (r.ids(a, b) == whole[a:b]).all()
    assert [i for ids, _ in r.documents(7) for i in ids] == [k for k, _ in docs]
    assert [n for _, ns in r.documents(7) for n in ns] == [len(x) for _, x in docs]
    rows = [x for f in pb._documents(r, True, window=1500) for x in f.itertuples(index=False)]
    assert [x.ids_crc32 for x in rows] == [zlib.crc32(x.astype("<u4").tobytes()) for _, x in docs]
    with pytest.raises(ValueError):
        pb.Reader(io.BytesIO(b"x" * 100), 100)


def check(rows, docs):
    """Rows against the library, in ascending id order; repeats of an id in any order."""
    expected = {}
    for ident, text in docs:
        ids = np.array([*library(text), 2], dtype="<u4")
        expected.setdefault(ident, []).append((len(ids), zlib.crc32(ids.tobytes())))
    at = 0
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((d for d, _ in docs), key=lambda d: (d is not None, d))
    for r in ordered:
        assert r.start == at
        expected[r.doc_id].remove((r.n_tokens, r.ids_crc32))
        at += r.n_tokens
    assert not any(expected.values())


@pytest.mark.parametrize("file_bytes", [1 << 28, 20_000])
def test_edge_rows(spark, file_bytes):
    docs = documents(spark).union(documents(spark).limit(6)).repartition(5)
    folder = scratch_path(spark, "pfor")
    pb.write(docs, TOKENIZER, folder, file_bytes=file_bytes)
    rows = pb.read(spark, folder, with_ids=True).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    ordered = sorted(rows, key=lambda r: r.start)
    whole = np.frombuffer(b"".join(r.ids for r in ordered), dtype="<u4")
    n = spark.read.parquet(f"{folder}/index").count()
    assert n == 1 if file_bytes > 1e6 else n > 5
    for a, b in [(0, 10), (len(whole) // 3, len(whole) // 3 + 40_000), (len(whole) - 3, len(whole) + 3)]:
        assert (pb.stretch(spark, folder, a, b) == whole[a:b]).all()


def test_nothing(spark):
    folder = scratch_path(spark, "pfor")
    pb.write(empty(spark), TOKENIZER, folder)
    assert pb.read(spark, folder).count() == 0 and len(pb.stretch(spark, folder, 0, 5)) == 0


def test_query(spark, folder):
    rows = QUERIES["op11_patched_blocks"](spark, folder).collect()
    check(rows, [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()])
