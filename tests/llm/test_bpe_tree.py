"""The tree reduction against the tiktoken library, at every leaf size."""

import base64
import hashlib
import random

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from offerloom.llm import bpetree
from offerloom.llm.bpetree import TreeEncoder

PATH, PATTERN = bpetree.default_vocabulary()
PIECES = ["a", "aa", " ", "  ", "\n", "\r\n", "'", "'re", "'s", "l", "ll", "ve", "é", "日本", "1", "12", "!", "--", "----", "\t", "　", "́", "🙂", "<|endoftext|>", "the", " quick", "ing", "\x00", "\x85"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def trees():
    return [TreeEncoder(PATH, PATTERN, c, b) for c, b in ((2, 1), (3, 2), (5, 7), (4096, 48))]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.lists(st.sampled_from(PIECES), max_size=60).map("".join), st.text(max_size=60)))
def test_any_text(library, trees, text):
    text = text.encode("utf-8", "ignore").decode()
    want = library.encode_ordinary(text)
    for tree in trees:
        packed = tree.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == want
        assert tree.decode(packed) == text.encode()


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, " " * 3000, "-" * 3001, "日本" * 900, "x y " * 3000, "'" * 500 + "re"])
def test_long_runs(library, trees, text):
    for tree in trees:
        assert np.frombuffer(tree.encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_long_random_word(library, trees):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(20000))
    assert np.frombuffer(trees[-1].encode(text), "<u4").tolist() == library.encode_ordinary(text)


def test_window_grows_until_outer_pairs_fit(trees):
    tree = trees[-1]
    data = b"a" * 70
    for cut in range(71):
        assert tree.join(tree.merge(data[:cut]), tree.merge(data[cut:])) == tree.merge(data)
    assert tree.merge(b"ab" * 500) == tree._merge_long(b"ab" * 500)


def test_column_forms(spark, library):
    long = "word " * 40_000
    rows = [(1, "Some text", "x"), (1, "Some text", "x"), (2, None, "y"), (3, "", None), (None, "no id 🙂", "z"), (4, long, "w")]
    docs = spark.createDataFrame([(*r, 7, "c") for r in rows], "doc_id long, text string, ids string, decoded int, row string")
    got = bpetree.decode_documents(bpetree.encode_documents(docs, PATH, PATTERN), PATH, PATTERN)
    assert set(got.columns) == set(docs.columns)
    found = sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded), r.row) for r in got.collect()), key=str)
    want = [(i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode(), "c") for i, t, _ in rows]
    assert found == sorted(want, key=str)
    assert bpetree.decode_documents(bpetree.encode_documents(docs.limit(0), PATH, PATTERN), PATH, PATTERN).count() == 0


def test_query(spark, library):
    got = {r.doc_id: r for r in bpetree.op11(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())
