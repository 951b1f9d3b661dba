"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from offerloom.llm import spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_counts(rows, slip):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def slow_variants(counts):
    words = sorted(counts)
    by_key = {}
    for w in words:
        for i in range(len(w) + 1):
            by_key.setdefault(w[:i] + "?" + w[i + 1 :], []).append(w)
            by_key.setdefault(w[:i] + "?" + w[i:], []).append(w)
    close = {w: {v for i in range(len(w) + 1) for k in (w[:i] + "?" + w[i + 1 :], w[:i] + "?" + w[i:]) for v in by_key[k] if near(w, v)} for w in words}
    form = {}
    for w in words:
        best = min(close[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 5 * counts[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(close[w]), counts[form[w]] if form[w] else None))
    return out


def some_words(rng, n, letters="abcdeé"):
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(n)]
    return {w: rng.choice([5, 6, 30, 40, 200, 1100]) for w in base}


@pytest.mark.parametrize("seed, letters, cell", [(1, "abcdeé", 4096), (2, "abcÿ×", 20), (3, "ab", 16)])
def test_variants(spark, seed, letters, cell):
    counts = some_words(random.Random(seed), 700, letters)
    df = spark.createDataFrame([(w, n, "x") for w, n in counts.items()], "word string, n long, form string")
    got = [tuple(r) for r in spelling.spelling_variants(df, cell_words=cell).collect()]
    assert len(got) == len(counts) and set(got) == slow_variants(counts)


def test_words_of_equal_letters(monkeypatch):
    rng = random.Random(5)
    words = sorted({"".join(rng.sample("aabbccde", 8)) for _ in range(900)})
    data = [w.encode("latin-1") for w in words]
    asked = [w.encode("latin-1") for w in words] + [w[:3].encode() + w[4:].encode() for w in words[:300]] + [w[:3].encode() + b"z" + w[3:].encode() for w in words[:300]] + [w[:3].encode() + b"c" + w[4:].encode() for w in words[:300]]
    want = {(i, j) for i, a in enumerate(asked) for j, b in enumerate(data) if near(a.decode(), b.decode())}
    assert want and set(zip(*map(list, spelling.Cell(data).near(asked)))) == want
    monkeypatch.setattr(spelling, "PAIRS", 8)
    q, d = spelling.Cell(data).near(asked)
    assert len(q) == len(want) and set(zip(q.tolist(), d.tolist())) == want


def test_very_long_words():
    long = b"a" * 70_000
    q, d = spelling.Cell([long, long[:-2] + b"bb"]).near([long, long[:-1], long[:-1] + b"b", b"b" * 70_000])
    assert set(zip(q.tolist(), d.tolist())) == {(1, 0), (2, 0), (2, 1)}


def test_counts(spark):
    rng = random.Random(8)
    words = ["Straße", "straße", "ÀÉÎÕÜÿ", "Abcdef", "abcdef", "abc", "x×y÷zz", "İstanbul", "wordłword"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(60)] + [(None, "Abcdef " * 9), (3, None), (4, ""), (5, "Abcdef"), (5, "Abcdef"), (6, "longest " * 50_000)]
    df = spark.createDataFrame([(*r, 1.0, "w") for r in rows], "doc_id long, text string, n double, word string")
    for slip in (None, 3):
        assert {r.word: r.n for r in spelling.word_counts(df, slip=slip).collect()} == slow_counts(rows, slip)
    assert spelling.spelling_variants(spelling.word_counts(df.limit(0))).count() == 0


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = [tuple(r) for r in spelling.op12(spark, "/root/testdata/sf0.001").collect()]
    counts = slow_counts(rows, 199)
    assert len(got) == len(counts) and set(got) == slow_variants(counts)
