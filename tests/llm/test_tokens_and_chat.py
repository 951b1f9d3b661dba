"""Token ids, packing, token files and chat formatting: exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from offerloom.llm import chat, packing, tokenfiles
from offerloom.llm.common import shared_folder
from offerloom.llm.grammar import Decoder, compress
from offerloom.llm.tokens import PieceEncoder, default_path

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  a", "a  b", "it's  we'll 'sabc ''s\n's x", "a\n\nb", "a\n b", " \n a", "a \n", "x y", "x   y", "日本 語。 x", "a\tb\n", "12ab,,..!!'t", "I'M I'm'll", "a\r\nb",
    "\x1fb a", "é x", "<|endoftext|> a<|endoftext|>", "' s", "a' b", "word.\n'tis", "　a", "a\x85 b", "x\n\n\ny z ", "\x00a b\x1c c", "a" * 3000,
]


@pytest.fixture(scope="module")
def encoder():
    return PieceEncoder(default_path(), table_bits=12)  # small enough to start anew


def library(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(encoder):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("ab1 2'  \n\t.,-s'tllmé x_\x1c日") for _ in range(rng.randint(0, 40))) for _ in range(2500)]
    assert [x.tolist() for x in encoder.encode(texts)] == [library(encoder, t) for t in texts]


def test_added_tokens_are_those_of_the_file_as_loaded(spark, encoder):
    fresh = Tokenizer.from_file(default_path())
    texts = ["<|endoftext|>", "end<|endoftext|>", "a <|endoftext|>\n<|endoftext|> b", "<|endoftext|" + "x" * 50, "plain", *ODD]
    want = [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert [x.tolist() for x in encoder.encode(texts)] == want and want[0] == [50256]
    df = spark.createDataFrame([(1, texts[2])], "doc_id long, text string")
    assert {p.doc_tokens for p in packing.pack_documents(df).collect()} == {len(want[2]) + 1}


@pytest.mark.parametrize("lengths", [[], [1], [2048], [5000, 3], [2049, 1], [1] * 3000, [random.Random(3).randint(1, 6000) for _ in range(400)]])
def test_pack_is_gapless_and_full(lengths):
    documents, sequences = {}, {}
    for d, start, size, s, offset in packing.pack(lengths):
        documents.setdefault(d, []).append((start, size))
        sequences.setdefault(s, []).append((offset, size))
    for parts, whole in [(documents.get(d, []), n) for d, n in enumerate(lengths)] + [(p, None) for p in sequences.values()]:
        at = 0
        for start, size in sorted(parts):
            assert start == at and size > 0
            at += size
        assert at == whole if whole is not None else at == 2048 or at & (at - 1) == 0
    assert sorted(sequences) == list(range(len(sequences)))


def test_descending_documents_go_to_the_cheapest_sequence():
    pieces = packing.pack([1500, 1400, 600, 500, 96])
    assert pieces[0][:4] == (0, 0, 1500, 0) and pieces[1][:4] == (1, 0, 1400, 1)
    assert pieces[2][0] == 2 and pieces[2][3] == 1  # 1400 cost less than 1500


ROWS = [(3, "c d"), (1, None), (2, ""), (2, "twice"), (2, "twice"), (None, "no id"), (2**60 + 1, "big id"), (7, "long " * 5000)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packed_documents(spark, encoder):
    df = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, start int").repartition(2)
    pieces = packing.pack_documents(df).collect()
    want = sorted(((i, len(library(encoder, t or "")) + 1) for i, t in ROWS), key=str)
    whole = [(p.doc_id, p.doc_tokens) for p in pieces if p.start == 0]
    assert sorted(whole, key=str) == want
    for i, t in ROWS:
        ids = library(encoder, t or "") + [1]
        own = [p for p in pieces if p.doc_id == i and p.doc_tokens == len(ids)]
        assert own and all(p.ids_crc32 == crc(ids[p.start : p.start + p.length]) for p in own)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_grammar_round_trip():
    rng = np.random.default_rng(1)
    for ids in ([], [5], [1] * 140, [1, 2] * 50, [1, 2, 3] * 40 + [9], rng.integers(0, 9, 4000).tolist(), rng.zipf(1.4, 5000).clip(max=60000).tolist()):
        ids = np.array(ids, np.uint32)
        symbols, rules, lengths, first = compress(ids, 8, 2)
        again = tokenfiles.unpack_symbols(tokenfiles.pack_symbols(symbols), len(symbols))
        decoder = Decoder(again, rules, lengths, first)
        assert decoder.read(0, len(ids)).tolist() == ids.tolist()
        for _ in range(30):
            a, b = sorted(rng.integers(0, len(ids) + 1, 2))
            assert decoder.read(int(a), int(b)).tolist() == ids[a:b].tolist()
    assert len(compress(np.array([1, 2] * 500, np.uint32))[0]) < 200


def test_token_files(spark, encoder):
    df = spark.createDataFrame([(t, i, "x") for i, t in ROWS], "text string, doc_id long, part string").repartition(3)
    folder = shared_folder(spark)
    tokenfiles.write_token_files(df, folder, block_tokens=50)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_token_files(spark, folder).collect()))
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {(i, t): library(encoder, t or "") + [2] for i, t in ROWS}
    assert [g[1] for g in got] == [i for i, _ in order]
    at = 0
    for start, i, n, c in got:
        assert start == at and (n, c) in {(len(x), crc(x)) for (j, _), x in ids.items() if j == i}
        at += n
    empty = shared_folder(spark)
    tokenfiles.write_token_files(df.limit(0), empty)
    assert tokenfiles.read_token_files(spark, empty).count() == 0


def test_chat_round_trip_of_conflicting_texts(spark):
    rng = random.Random(1)
    parts = ["</s>", "<s>", "<s~>", "[INST]", "[/INST]", "~", "~0", "~1", "<", "[", "\n", "a", " ", "/s>", "INST]", "é", "<s", "</"]
    rows = [(i // 3, i % 3, rng.choice(["user", "assistant", "a<s>\nb", "", "~[INST]", None, "system"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) if i % 50 else None) for i in range(900)]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "first"), (-5, 0, "user", "same"), (-5, 0, "user", "same"), (-5, 0, "assistant", "b")]
    df = spark.createDataFrame([(*r, "p") for r in rows], "conv_id long, turn long, role string, text string, parsed string")
    source = {}
    for c, n, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or "")):
        source.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    source = {c: [x[2:] for x in sorted(v)] for c, v in source.items()}
    formatted = chat.format_conversations(df)
    assert {r.conv_id: [(t.role, t.text) for t in r.parsed] for r in formatted.collect()} == source
    for r in chat.digests(formatted).collect():
        turns = source[r.conv_id]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_chat_query_is_native(spark):
    df = chat.op7(spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    own = df.where("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert (own.n_turns, own.loss_chars, own.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
