from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from gleaner.llm import packing, tree_bpe
from gleaner.llm.queries import QUERIES, TOKENIZER
from gleaner.llm.tokens import WordEncoder, encoder
from tests.llm.cases import documents, empty


def library(text):
    return encoder(TOKENIZER).tokenizer.encode(text or "", add_special_tokens=False).ids


def raw(ids):
    return np.asarray(ids, dtype="<u4").tobytes()


ALPHABET = list("ab  \n\t\r'.!éİΣσ²½1<|>\x1c\x85字🙂́") + ["<|endoftext|>", "'re", "the", "THE", " "]


def texts(n, seed, most=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_cached_encoder_equals_the_library():
    some = texts(2000, 1) + ["Ünïcödé Straße ça, (va) 12x3 ºª µ"]
    assert WordEncoder(TOKENIZER).ids(some) == [raw(library(t)) for t in some]
    tiny = WordEncoder(TOKENIZER, cache_pieces=50)  # emptied again and again
    assert tiny.ids(some) == [raw(library(t)) for t in some]


def test_tree_equals_the_library_at_any_cut():
    coder = encoder(TOKENIZER)
    for t in texts(1500, 2):
        assert tree_bpe.encode_tree(coder, t, 3).joined() == raw(library(t))


def unsplit(n, seed):
    """Texts without a blank, of few characters that merge across any cut."""
    rng = random.Random(seed)
    kinds = ["abcdeiourstn", "aB1,.'!é", "ab'stre", "e\u0301o\u0308\u0323aA", "字漢🙂한가각", "\u1112\u1161\u11ab", "<|endoftext|>ab"]
    for _ in range(n):
        kind = rng.choice(kinds)
        words = [kind] if rng.random() < 0.2 else kind
        yield "".join(rng.choice(words) + rng.choice(["", "", "", "<|endoftext|>", "'re"] if rng.random() < 0.05 else [""]) for _ in range(rng.randrange(300, 1500)))


def test_windows_inside_unsplit_text_equal_the_library():
    coder = encoder(TOKENIZER)
    for k, t in enumerate(unsplit(250, 4)):
        for leaf_chars in (7, 40, 333):
            assert tree_bpe.encode_tree(coder, t, leaf_chars).joined() == raw(library(t)), (k, leaf_chars)


def test_joins_of_a_long_unsplit_text_read_little_again(monkeypatch):
    coder, rng = encoder(TOKENIZER), random.Random(1)
    text = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    read, real = [], tree_bpe.with_offsets
    monkeypatch.setattr(tree_bpe, "with_offsets", lambda c, t: (read.append(len(t)), real(c, t))[1])
    encoded = tree_bpe.encode_tree(coder, text, 16_384)
    leaves = [n for n in read if n > 5000]
    assert sum(leaves) == len(text)  # every leaf once
    assert sum(read) - sum(leaves) < 0.01 * len(text)
    monkeypatch.undo()
    assert encoded.joined() == raw(library(text))


def check_digests(frame, rows):
    tokenizer = encoder(TOKENIZER).tokenizer
    expected = []
    for ident, text in rows:
        ids = library(text)
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        expected.append((
            ident, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(),
        ))
    got = [tuple(r) for r in frame.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("leaf,span", [(16_384, 65_536), (64, 300)])
def test_encoding_edge_rows(spark, leaf, span):
    docs = documents(spark)
    encoded = tree_bpe.encode(docs, TOKENIZER, leaf_chars=leaf, span_chars=span)
    check_digests(tree_bpe.digests(encoded, TOKENIZER), docs.select("doc_id", "text").collect())
    first = tree_bpe.decode(encoded.filter("doc_id = 5"), TOKENIZER).first()
    assert first.decoded == encoder(TOKENIZER).tokenizer.decode(library("two words"))
    assert tree_bpe.encode(empty(spark), TOKENIZER).count() == 0


def test_encoding_query(spark, folder):
    check_digests(QUERIES["op6_tree_bpe"](spark, folder), spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())


def check_pieces(rows, ids_of, size=2048):
    """Every id in one piece, windows gapless and within the size; returns the share of padding."""
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= size
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        copies = ids_of[doc]
        assert sum(p.length for p in pieces) == sum(len(c) for c in copies)
        for p in pieces:
            assert any(len(c) == p.doc_tokens and zlib.crc32(raw(c[p.start : p.start + p.length])) == p.ids_crc32 for c in copies)
        if len(copies) == 1:
            assert sorted((p.start, p.start + p.length) for p in pieces)[0][0] == 0
            ordered = sorted(pieces, key=lambda p: p.start)
            assert all(a.start + a.length == b.start for a, b in zip(ordered, ordered[1:], strict=False))
    return 1 - sum(r.length for r in rows) / (size * len(by_sequence))


def ids_by_doc(frame):
    out = {}
    for ident, text in frame.select("doc_id", "text").collect():
        out.setdefault(ident, []).append([*library(text), 1])
    return out


def test_packing_query(spark, folder):
    rows = QUERIES["op5_packing"](spark, folder).collect()
    assert check_pieces(rows, ids_by_doc(spark.read.parquet(f"{folder}/documents.parquet"))) < 0.02


@pytest.mark.parametrize("parts,fan_in,open_windows,size", [(1, 64, 32, 2048), (9, 2, 3, 64), (7, 3, 1, 16)])
def test_packing_edge_rows_and_merge_rounds(spark, parts, fan_in, open_windows, size):
    docs = documents(spark).union(documents(spark).limit(6)).repartition(parts)
    packed = packing.pack(docs, TOKENIZER, size=size, fan_in=fan_in, open_windows=open_windows, min_cut=4).collect()
    assert check_pieces(packed, ids_by_doc(docs), size) < (0.9 if size == 2048 else 0.12)
    for r in packed:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length


def test_packing_nothing(spark):
    assert packing.pack(empty(spark), TOKENIZER).count() == 0


def test_best_fit_and_fullest_out():
    p = packing.Packer(10, 2, 5)
    piece = lambda n: packing.Piece("d", 0, raw(range(n)), n)
    p.add(piece(6)), p.add(piece(8)), p.add(piece(2))
    assert p.free == [4] and [sum(map(len, w)) for w in p.closed] == [10]  # the two went best-fit to the eight
    p.add(piece(7)), p.add(piece(5))
    assert [sum(map(len, w)) for w in p.closed] == [10, 7]  # none fits: the fullest is emitted, its gap too small to cut for
    assert sorted(p.free) == [4, 5]
