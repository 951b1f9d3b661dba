"""Relevance judging in batches, verdict parsing, the verdict join and feature merge.

A judge is any Python callable; no network client lives here. Batches are cut by input position,
never by physical partition, so the same offers always form the same batches.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from offerloom import constants as K
from offerloom.functions import envelopes, text
from offerloom.operators.skew import first_row, ordered_rank
from offerloom.schema import PLACE
from offerloom.session import durable, shuffles_end

c = F.col
RUN = ["slug", "run_ts"]
BATCH = [*RUN, "batch"]
USAGE = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]


@dataclass(frozen=True)
class Judge:
    """`call` gets the JSON payload text of one batch and returns the answer text, or (text, usage dict)."""

    provider: str
    model: str
    call: Callable[[str], object]


def pass_all(payload: str) -> str:
    return json.dumps({"evaluations": [{"index": e["index"], "pass": True} for e in json.loads(payload)]})


DEFAULT_CHAIN = (Judge("local", "pass-all", pass_all),)


SHOWN = ["title", "url", "source", "unit_price_usd", "condition", "is_kit", "kit_module_count", "quantity_available", "attrs"]


def payload_entry(index: Column, offer: Callable[[str], Column] = c, aliases: Column | None = None) -> Column:
    """What a judge sees of one offer (*offer*: name -> column); the alias signal only exists for profiles that have aliases."""
    fields = [index.alias("index"), *[offer(n).alias("price" if n == "unit_price_usd" else n) for n in SHOWN]]
    if aliases is not None:
        signal = F.when(F.size(aliases) > 0, text.title_has_alias(offer("title"), aliases))
        fields.append(signal.alias("model_name_in_title"))
    return F.struct(*fields)


def batched(offers: DataFrame, size: int = K.JUDGE_BATCH) -> DataFrame:
    """Offers with `index` (0-based in the run), `batch` and `local_index`."""
    zero = ordered_rank(offers, RUN, [c(n) for n in PLACE], "_rank").withColumn("index", c("_rank") - 1).drop("_rank")
    return zero.withColumn("batch", F.floor(c("index") / size)).withColumn("local_index", (c("index") % size).cast("int"))


def batch_rows(offers: DataFrame, size: int = K.JUDGE_BATCH) -> DataFrame:
    """One row per batch with its offers (at most *size*) and the payload text, which is made once the offers have met."""
    return grouped(batched(offers, size))


def grouped(rows: DataFrame) -> DataFrame:
    """batch_rows of offers that `batched` has numbered."""
    keep = [n for n in rows.columns if n not in (*BATCH, "local_index", "index")]
    item = F.struct(c("local_index"), c("index"), F.struct(*keep).alias("offer"))

    def entry(i: Column) -> Column:
        return F.to_json(payload_entry(i["local_index"], lambda n: i["offer"][n], i["offer"]["aliases"] if "aliases" in keep else None))

    return (
        rows.groupBy(*BATCH)
        .agg(F.collect_list(item).alias("items"))
        .withColumn("items", F.array_sort("items", lambda a, b: a["local_index"] - b["local_index"]))
        .withColumn("payload", F.concat(F.lit("["), F.array_join(F.transform("items", entry), ","), F.lit("]")))
        .withColumn("n", F.size("items"))
    )


def payloads(rows: DataFrame, size: int) -> DataFrame:
    """Payload text and `n` of every batch of offers that `batched` has numbered, without the offers; written, by `_wave`.

    Numbered offers lie in order, so that the entries of most batches meet in the task that reads them. Only batches that
    a task sees in parts (and the last ones of runs) are put together by key. Batches of a run without product or time are left out.
    """
    shown = rows.where(c("slug").isNotNull() & c("run_ts").isNotNull())
    text_of = F.to_json(payload_entry(c("local_index"), aliases=c("aliases") if "aliases" in rows.columns else None))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        for b in batches:
            if b.num_rows == 0:
                continue
            place = b.column("local_index").to_numpy()
            begins = np.ones(b.num_rows, bool)
            begins[1:] = place[1:] != place[:-1] + 1
            for name in BATCH:
                begins[1:] |= pc.not_equal(b.column(name)[1:], b.column(name)[:-1]).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(begins)
            ends = np.append(starts, b.num_rows)
            entries = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), b.column("entry"))
            at = pa.array(starts)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(n).take(at) for n in BATCH], b.column("local_index").take(at), pa.array(np.diff(ends), pa.int32()), pc.binary_join(entries, ",")],
                [*BATCH, "first", "n", "entries"],
            )

    parts = shown.select(*BATCH, "local_index", text_of.alias("entry")).mapInArrow(joined, "slug string, run_ts timestamp, batch bigint, first int, n int, entries string")
    payload = lambda x: F.concat(F.lit("["), x, F.lit("]")).alias("payload")
    parts = durable(parts.withColumn("_wave", F.when(c("n") == size, wave_of(c("batch"))).otherwise(F.lit(-1))), by="_wave")
    whole = parts.where(c("_wave") >= 0).select(*BATCH, "n", payload(c("entries")), "_wave")
    rest = parts.where(c("_wave") < 0).groupBy(*BATCH).agg(F.array_sort(F.collect_list(F.struct("first", "entries"))).alias("p"), F.sum("n").cast("int").alias("n"))
    rest = rest.select(*BATCH, "n", payload(F.array_join(F.transform("p", lambda x: x["entries"]), ",")), wave_of(c("batch")).alias("_wave"))
    return whole.unionByName(durable(rest, by="_wave"))


def wave_of(place: Column) -> Column:
    """Waves hold 1, 2, 4 ... batches of a run: the wave of its *place*-th open batch."""
    return (F.length(F.bin(place + 1)) - 1).cast("int")


@dataclass(frozen=True)
class ReplyStore:
    """Judge answers kept in a table, so that a run that is started again asks nothing twice.

    An answer belongs to a batch of a run, its payload text, provider and model; another run, or a batch that has
    changed, is asked anew. A call that raised is made again, an answer that could not be read was paid for and stays.
    Answers are in the table as soon as their task ends, of about *calls_per_task* calls, more where a wave has over
    *most_tasks* times as many (a file per eight calls would cost more than the calls): a lost executor repeats
    the calls of its open tasks, a job that dies keeps what its tasks had stored. One writer per run at a time.
    """

    path: str
    calls_per_task: int = 8
    most_tasks: int = 400


BATCH_DDL = ["slug string", "run_ts timestamp", "batch bigint"]
REPLY = [*BATCH_DDL, "payload_key string", "reply string", "error string", *[u + " bigint" for u in USAGE]]


def stored_replies(spark: SparkSession, store: ReplyStore, judge: Judge) -> DataFrame:
    """Rows of calls to *judge*, those that raised included, with the `attempt` that made them. None before the first."""
    ddl = ", ".join([*REPLY, "attempt string"])
    try:
        return spark.read.schema(ddl).parquet(f"{store.path}/{reply_folder(judge)}")
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def reply_folder(judge: Judge) -> str:
    return "/".join(quote(n, safe="") for n in (judge.provider, judge.model))


def ask(batches: DataFrame, judge: Judge, store: ReplyStore | None = None) -> DataFrame:
    """Answer text, usage, error and verdicts of *judge* for every batch (keys, n, payload); only these cross to Python.

    With a *store*, answers it holds are used, the other batches are asked, and new answers are stored first. Answers that
    are alike take little room in a file and much in memory, so no join may broadcast them.
    """
    call = judge.call
    keys = [*BATCH, "n"] if store is None else [*BATCH, "payload_key"]
    ddl = [*BATCH_DDL, "n int", *REPLY[4:]] if store is None else REPLY

    def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key in frame.itertuples(index=False):
                reply, error, usage = None, None, {}
                try:
                    out = call(key.payload)
                    reply, usage = out if isinstance(out, tuple) else (out, {})
                except Exception as exc:  # noqa: BLE001 - a failing judge is a result, not a crash
                    error = f"ai_filter exception: {exc!r}"
                rows.append((*[getattr(key, k) for k in keys], reply, error, *[int(usage.get(u) or 0) for u in USAGE]))
            yield pd.DataFrame(rows, columns=[*keys, "reply", "error", *USAGE])

    if store is None:
        replies = batches.select(*keys, "payload").mapInPandas(answer, ", ".join(ddl))
    else:
        id_, attempt = [*BATCH, "payload_key"], uuid.uuid4().hex
        spark = batches.sparkSession
        asked = durable(batches.select(*BATCH, "n", F.sha2("payload", 256).alias("payload_key")))
        stored = lambda: stored_replies(spark, store, judge).hint("shuffle_merge")
        new = durable(asked.join(stored().where(c("error").isNull()), id_, "left_anti").drop("n"))
        n = new.count()
        if n:
            tasks = min(-(-n // store.calls_per_task), store.most_tasks)
            fresh = batches.select(*BATCH, "payload").join(new, BATCH).select(*id_, "payload").repartition(max(1, tasks), *BATCH)
            with shuffles_end(spark):
                fresh.mapInPandas(answer, ", ".join(ddl)).withColumn("attempt", F.lit(attempt)).write.mode("append").option(
                    "mapreduce.fileoutputcommitter.algorithm.version", "2"
                ).parquet(f"{store.path}/{reply_folder(judge)}")
        # A call that an interrupted task repeated has two answers: one of them counts.
        now = asked.join(stored().where(c("error").isNull() | (c("attempt") == attempt)), id_)
        replies = first_row(now, id_, [c("error").isNotNull(), c("reply")]).drop("payload_key", "attempt")
    read = (
        replies.withColumn("envelope", envelopes.envelope_text(c("reply")))
        .withColumn("verdicts", envelopes.verdict_list(c("envelope"), c("n"))).drop("envelope")
        .withColumn("provider", F.lit(judge.provider)).withColumn("model", F.lit(judge.model))
    )
    unread = F.concat(F.lit("ai_filter parse failure: "), F.coalesce(F.substring("reply", 1, 200), F.lit("")))
    return read.withColumn("error", F.coalesce("error", F.when(c("verdicts").isNull(), unread)))


def run_chain(
    offers: DataFrame, chain: Sequence[Judge] = DEFAULT_CHAIN, size: int = K.JUDGE_BATCH, store: ReplyStore | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answered batches, failed runs, all calls made).

    Judges are tried in order. From the first batch of a run that a judge fails on, the next judge takes over
    for the rest of that run. A run with batches left after the last judge has failed. A judge is asked in
    waves of 1, 2, 4 ... batches of every run, and no more for a run it has failed on, so a dead judge costs
    one call per run, and one that dies later at most as many calls as it has answered. Every call counts; with a
    *store*, a call that an earlier attempt at the run has made counts once, when its answer is used.

    The numbered offers are written once, and the payloads of a judge's open batches by wave, so that a wave reads its own.
    What waves write is answers, which meet the offers at the end, where the caller reads them.
    """
    rows = batched(offers, size)
    begun = durable(rows.groupBy(*RUN).agg(F.lit(0).cast("bigint").alias("_first"), F.max("batch").alias("_last")))
    done, calls, failed, open_ = [], [], None, None
    keep = [*BATCH, "provider", "model", *USAGE]
    for judge in chain:
        last = begun.where(c("slug").isNotNull() & c("run_ts").isNotNull()).agg(F.max(c("_last") - c("_first"))).first()[0]
        if last is None:
            break
        if open_ is None:
            open_ = payloads(rows, size)
        else:
            left = open_.drop("_wave").join(begun.select(*RUN, "_first"), RUN).where(c("batch") >= c("_first"))
            open_ = durable(left.withColumn("_wave", wave_of(c("batch") - c("_first"))).drop("_first"), by="_wave")
        broken, answers = None, []
        for no in range(int(math.log2(last + 1)) + 1):
            wave = open_.where(c("_wave") == no).drop("_wave")
            if broken is not None:
                wave = wave.join(broken.select(*RUN), RUN, "left_anti")
            answered = durable(ask(wave, judge, store))
            answers.append(answered)
            now = answered.where(c("error").isNotNull()).groupBy(*RUN).agg(F.min("batch").alias("first_bad"), F.min_by("error", "batch").alias("bad_reason"))
            broken = durable(now if broken is None else broken.unionByName(now))
        failed = broken.select(*RUN, "first_bad", "bad_reason")
        answered = reduce(DataFrame.unionByName, answers)
        calls.append(answered.select(*keep))
        done.append(answered.join(broken.select(*RUN, "first_bad"), RUN, "left").where(c("first_bad").isNull() | (c("batch") < c("first_bad"))).drop("first_bad"))
        begun = durable(begun.drop("_first").join(failed.select(*RUN, c("first_bad").alias("_first")), RUN))
    batches = grouped(rows)
    if not done:  # no batch, or no judge: what is pending has failed
        empty = ask(batches.select(*BATCH, "n", "payload").limit(0), chain[0] if chain else DEFAULT_CHAIN[0])
        none = batches.join(empty.drop("n"), BATCH)
        return none, begun.select(*RUN, F.lit(0).cast("bigint").alias("first_bad"), F.lit("no judge").alias("bad_reason")), empty.select(*keep)
    answers = reduce(DataFrame.unionByName, done).drop("n").hint("shuffle_merge")
    return batches.join(answers, BATCH), failed, reduce(DataFrame.unionByName, calls)


def verdict_rows(answered: DataFrame) -> DataFrame:
    """One row per judged offer: the first verdict given for its index, or 'no verdict'."""

    def pair(item: Column) -> Column:
        verdict = F.get(F.filter("verdicts", lambda v: v["index"] == item["local_index"]), F.lit(0))
        return F.struct(item["index"].alias("index"), verdict.alias("verdict"), item["offer"].alias("offer"))

    rows = answered.select(*RUN, F.explode(F.transform("items", pair)).alias("r")).select(*RUN, "r.index", "r.verdict", "r.offer.*")
    return settle(rows, c("verdict"))


def settle(rows: DataFrame, verdict: Column) -> DataFrame:
    """pass / reason columns with the defaults for missing verdicts and empty reasons; features merged into attrs."""
    passed = F.coalesce(verdict["pass"], F.lit(False))
    reason = F.when(verdict.isNull(), "no verdict returned by model").otherwise(
        F.coalesce(F.nullif(verdict["reason"], F.lit("")), F.when(passed, "passed all rules").otherwise("no reason given"))
    )
    merged = F.when(
        passed, envelopes.merge_features(verdict["features"], c("attrs"), c("condition"), c("brand"), c("quantity_available"))
    ).otherwise(c("attrs"))
    return rows.withColumn("reason", reason).withColumn("pass", passed).withColumn("attrs", merged).drop("verdict")


def join_verdicts(offers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Left join of indexed offers with verdict rows (slug, run_ts, index, seq, pass, reason, features); the first per index wins."""
    first = first_row(verdicts.where(c("index") >= 0), [*RUN, "index"], [c("seq")]).select(
        *RUN, "index", F.struct("pass", "reason", "features").alias("verdict")
    )
    return settle(offers.join(first, [*RUN, "index"], "left"), c("verdict"))


def log_rows(judged: DataFrame) -> DataFrame:
    """Verdict-log rows of judged offers."""
    return judged.select(
        *RUN, c("index").cast("bigint").alias("index"), "pass", "reason", "title", c("unit_price_usd").alias("price"),
        "url", "source", F.try_element_at(c("attrs"), F.lit("source_url")).alias("source_url"),
    )


def failure_log(failed: DataFrame) -> DataFrame:
    """The sentinel row of a run whose judges all failed."""
    none = lambda t: F.lit(None).cast(t)
    return failed.select(
        *RUN, F.lit(-1).cast("bigint").alias("index"), F.lit(False).alias("pass"),
        F.format_string("%s (batch %d)", c("bad_reason"), c("first_bad") + 1).alias("reason"),
        F.lit("(filter call failed)").alias("title"), none("double").alias("price"), none("string").alias("url"),
        none("string").alias("source"), none("string").alias("source_url"),
    )


def usage(calls: DataFrame) -> DataFrame:
    """Tokens per run and model in the run-call shape, over all calls, discarded answers included."""
    return calls.groupBy(*RUN, "provider", "model").agg(*[F.sum(u).alias(u) for u in USAGE]).select(
        *RUN, F.lit("ai_filter").alias("step"), "provider", "model", *USAGE, F.lit(None).cast("double").alias("cost_usd")
    )


def parse_replies(replies: DataFrame) -> DataFrame:
    """(keys..., reply, n) -> verdict rows with `seq`; replies of no accepted shape give none."""
    keys = [n for n in replies.columns if n not in ("reply", "n")]
    found = replies.withColumn("envelope", envelopes.envelope_text(c("reply")))
    parsed = found.withColumn("v", envelopes.verdict_list(c("envelope"), c("n")))
    return parsed.select(*keys, "n", F.posexplode("v").alias("seq", "e")).select(*keys, "n", "seq", "e.*")
