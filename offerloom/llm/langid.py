"""Language identification with bit-sliced Bloom filters of character n-grams.

One table serves all languages: a slot is a bit mask with one bit per language, in as many 64-bit words as they
need, so one look-up of an n-gram returns every language whose filter contains it. Per document the masks' bits are counted per language,
the counts are corrected for the false positives expected from each filter's fill, and the largest wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from offerloom.llm.common import add_columns, digest, held_out, keep_rows, query, share, table, worker_value, written

GRAM = 5  # characters of an n-gram, word edges included
SLOT_BITS = 20  # the filters have 2**20 slots
HASHES = 2
SAMPLE_ROWS = 2000  # documents per language that the filters learn from
LEAST_RATE = 2e-6  # share of a language's n-grams that an n-gram must have to be put into its filter
LEAST_DOCS = 3  # documents of the language that must have it; fewer in a rare language
RARE_DOCS = 20  # documents of a language for each document of LEAST_DOCS
LEAST_SHARE = 0.1  # of its rate in the language where it is most frequent; less is that language's text in documents of others
WORD = 64  # languages of one word of a slot's mask
UNKNOWN = "und"
LEAST_COVERAGE = 0.2  # share of n-grams that a document of a learned language has at least
SURE_LETTERS = 100  # letters from which on that share is reliable
SLICE_CHARS = 1 << 18
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _letters() -> np.ndarray:
    """For every code point its simple lower case if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def gram_codes(texts: list[str], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, document of each code, letters per document) of all character n-grams of the texts.

    Texts are lower-cased; any stretch of other characters than letters counts as one blank, also at both
    ends. Texts shorter than an n-gram have one code of what they have.
    """
    letters = worker_value("letters", None, _letters)
    joined = "\n".join(texts) + "\n"
    points = letters[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    stops = np.cumsum(lengths)
    is_letter = points > 0
    upto = np.concatenate([[0], np.cumsum(is_letter)])
    n_letters = upto[stops] - upto[stops - lengths]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    keep[0] = True
    keep[stops[:-1]] |= True  # a blank or a letter at every start
    doc = np.repeat(np.arange(len(texts)), lengths)[keep]
    points = points[keep].astype(np.uint64)
    code = np.zeros(max(0, len(points) - gram + 1), np.uint64)
    for k in range(gram):
        code = code * np.uint64(0x100000001B3) + points[k : k + len(code)]
    same = doc[: len(code)] == doc[gram - 1 :]
    return code[same], doc[: len(code)][same], n_letters


def slots(codes: np.ndarray, slot_bits: int = SLOT_BITS, hashes: int = HASHES) -> list[np.ndarray]:
    return [((codes ^ codes >> np.uint64(31)) * _MIX[k] >> np.uint64(64 - slot_bits)).astype(np.int64) for k in range(hashes)]


def _slices(texts: list[str]) -> Iterator[list[str]]:
    at = 0
    while at < len(texts):
        begin, size = at, 0
        while at < len(texts) and (at == begin or size + len(texts[at]) < SLICE_CHARS):
            size += len(texts[at])
            at += 1
        yield texts[begin:at]


class Filters:
    """languages[i] has bit i % WORD of every slot of masks[i // WORD]; fill[i] is the share of slots with that bit."""

    def __init__(self, languages: list[str], masks: np.ndarray, prior: int = 0) -> None:
        self.languages, self.masks, self.prior = languages, np.atleast_2d(masks), prior
        self.slot_bits = self.masks.shape[1].bit_length() - 1
        self.fill = np.array([self._bit(self.masks[i // WORD], i).mean() for i in range(len(languages))])

    def _bit(self, mask: np.ndarray, i: int) -> np.ndarray:
        return (mask >> self.masks.dtype.type(i % WORD)) & self.masks.dtype.type(1)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(corrected counts per document and language, n-grams per document, letters per document)."""
        if not texts:
            return np.zeros((0, len(self.languages))), np.zeros(0), np.zeros(0, np.int64)
        counts, totals, letters = [], [], []
        false_rate = np.minimum(self.fill**HASHES, 0.999)
        for part in _slices(texts):
            codes, doc, n_letters = gram_codes(part)
            at = slots(codes, self.slot_bits)
            total = np.bincount(doc, minlength=len(part)).astype(np.float64)
            hits = np.zeros((len(part), len(self.languages)))
            for word, masks in enumerate(self.masks):
                mask = np.bitwise_and.reduce([masks[s] for s in at])
                for i in range(word * WORD, min(len(self.languages), (word + 1) * WORD)):
                    hits[:, i] = np.bincount(doc[self._bit(mask, i) > 0], minlength=len(part))
            counts.append(np.maximum(0, (hits - total[:, None] * false_rate) / (1 - false_rate)))
            totals.append(total)
            letters.append(n_letters)
        return np.concatenate(counts), np.concatenate(totals), np.concatenate(letters)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(languages, scores, coverages): the winner's count against the runner-up's, and against all n-grams."""
        if not texts or not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        counts, totals, letters = self.scores([t or "" for t in texts])
        best = counts.argmax(1)
        top = counts[np.arange(len(best)), best]
        best = np.where(top > 0, best, self.prior)
        rest = counts.copy()
        rest[np.arange(len(best)), best] = 0
        score = np.where(top > 0, top / np.maximum(top + rest.max(1), 1e-9), 1 / (1 + len(self.languages)))
        some = letters > 0
        return [self.languages[b] if s else UNKNOWN for b, s in zip(best, some)], np.where(some, score, 0.0), np.where(some, top / np.maximum(totals, 1), 0.0)


def _sample_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lang, group in pdf.groupby("lang"):
            for part in _slices(group["text"].tolist()):
                codes, doc, _ = gram_codes(part)
                order = np.lexsort((doc, codes))
                codes, doc = codes[order], doc[order]
                new = np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]
                number = np.cumsum(new) - 1
                new_doc = new | np.concatenate([[True], doc[1:] != doc[:-1]])[: len(codes)]
                count, docs = np.bincount(number), np.bincount(number[new_doc])
                codes = codes[new]
                yield pd.DataFrame({"lang": lang, "code": codes.view(np.int64), "n": count, "docs": docs})


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, slot_bits: int = SLOT_BITS) -> Filters:
    """Learn the filters from (doc_id, text, lang): rows in the learning folds, with text and lang.

    A bounded sample of about *sample_rows* documents per language (those whose ids hash lowest) is counted; an
    n-gram goes into a language's filter if its share there is LEAST_RATE or more, LEAST_DOCS documents have
    it (one for every RARE_DOCS documents of the language, where that is less), and no language has it more than
    1 / LEAST_SHARE times as often. Every language has a filter. What comes to the driver is a row per language
    and the table of slots, whose size is fixed for each WORD languages.
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("n"), "lang").collect()
    languages = sorted(r.lang for r in counts)
    masks = np.zeros((max(1, -(-len(languages) // WORD)), 1 << slot_bits), np.uint8 if len(languages) <= 8 else np.uint64)
    if not languages:
        return Filters([], masks)
    shares = spark.createDataFrame([(r.lang, min(1.0, sample_rows / r.n), min(LEAST_DOCS, max(1, -(-r.ids // RARE_DOCS)))) for r in counts], "lang string, share double, least int")
    chance = (F.xxhash64("doc_id").cast("double") + 2.0**63) / 2.0**64
    sample = known.join(F.broadcast(shares), "lang").where(chance <= F.col("share")).select("doc_id", "lang", "text")
    picked = sample.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")  # repeated ids count once
    grams = picked.mapInPandas(_sample_grams, "lang string, code long, n long, docs long").groupBy("lang", "code").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    grams = written(grams)
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total")).join(F.broadcast(shares), "lang")  # a row per language
    chosen = grams.join(F.broadcast(totals), "lang").where((F.col("n") >= LEAST_RATE * F.col("total")) & (F.col("docs") >= F.col("least")))
    rates = chosen.select("code", "lang", "docs", (F.col("n") / F.col("total")).alias("rate")).groupBy("code").agg(F.collect_list(F.struct("rate", "lang", "docs")).alias("all"))  # an entry per language
    # one or two documents give a rate that is too rough to take the n-gram from another language
    most = F.coalesce(F.array_max(F.filter("all", lambda x: x["docs"] >= LEAST_DOCS))["rate"], F.lit(0.0))
    clear = F.filter("all", lambda x: x["rate"] >= LEAST_SHARE * most)
    chosen = rates.select("code", F.explode(clear).alias("x")).select("code", "x.lang")
    bits = chosen.select("lang", "code").mapInPandas(_slot_rows(slot_bits, languages), "slot long, word int, bit long")
    for r in bits.groupBy("slot", "word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        masks[r.word, r.slot] = r.bits & 0xFFFFFFFFFFFFFFFF
    return Filters(languages, masks, languages.index(counts[0].lang))


def _slot_rows(slot_bits: int, languages: list[str]):
    number = {lang: i for i, lang in enumerate(languages)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = pdf["lang"].map(number).to_numpy(np.int64)
            bit = np.left_shift(np.int64(1), own % WORD)
            for s in slots(pdf["code"].to_numpy(np.int64).view(np.uint64), slot_bits):
                yield pd.DataFrame({"slot": s, "word": (own // WORD).astype(np.int32), "bit": bit})

    return run


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """*docs* with lang_pred, score and coverage for its column text. Null texts and texts without a letter are
    `und`, score 0. score compares the winner with the runner-up (0.5: as many n-grams), coverage is the winner's
    share of the text's n-grams (near 0: a language that was not learned).

    The text is scored whole. A text none of whose n-grams is known gets the most frequent learned language
    with a low score. Equal counts go to the language first in the alphabet. Columns of *docs* with
    these names are replaced.
    """
    model = share(docs.sparkSession, (filters.languages, filters.masks, filters.prior))

    def compute(texts: list) -> dict:
        return dict(zip(("lang_pred", "score", "coverage"), worker_value("filters", key, lambda: Filters(*model.value)).predict(texts)))

    key = digest((filters.languages, filters.masks, filters.prior))
    return add_columns(docs, compute, "lang_pred string, score double, coverage double")


def drop_unknown(docs: DataFrame, filters: Filters, coverage: float = LEAST_COVERAGE, letters: int = SURE_LETTERS) -> DataFrame:
    """The documents with a letter, but for those of *letters* or more whose language was not learned.

    With no language learned, only documents without a letter go.
    """
    model = share(docs.sparkSession, (filters.languages, filters.masks, filters.prior))
    key = digest((filters.languages, filters.masks, filters.prior))

    def decide(texts: list) -> np.ndarray:
        own = worker_value("filters", key, lambda: Filters(*model.value))
        counts, totals, n_letters = own.scores([t or "" for t in texts])
        known = counts.max(1, initial=0) >= coverage * totals
        return (n_letters > 0) & (known | (n_letters < letters) | (not own.languages))

    return keep_rows(docs, decide)


@query("op1_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    filters = train(docs.select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), filters).drop("text")
