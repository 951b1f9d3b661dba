"""Streaming twins: deduplicated ingest, latest-per-day upkeep, tick windows, stateful alerts, alert sink.

Alert state is one row per key and run, never offers: a stream of offers is first reduced to run
facts (`alerts.run_prices` / `run_hosts` inside foreachBatch, or an upstream run table).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from offerloom import constants as K
from offerloom.sources import tables

c = F.col


def ingest(offers: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each (slug, url, fetched_at) once, within the lateness bound."""
    return offers.withWatermark("fetched_at", lateness).dropDuplicatesWithinWatermark(["slug", "url", "fetched_at"])


def history_writer(path: str):
    """foreachBatch function: upsert a batch of offers into the history table. Replays give the same table."""

    def write(batch: DataFrame, _: int) -> None:
        tables.upsert_history(batch.sparkSession, batch, path)

    return write


def latest_writer(path: str):
    """foreachBatch function keeping one row per (slug, url, day): what was seen last that day."""

    def write(batch: DataFrame, _: int) -> None:
        tables.keep_latest(batch.sparkSession, batch, path)

    return write


def tick_counts(fires: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Fire instants per product and tick. A tick covers (start, end]; Spark windows are [start, end), hence the shift."""
    shifted = fires.withColumn("_t", c("fire_at") - F.expr("interval 1 microsecond")).withWatermark("_t", lateness)
    window = F.window("_t", f"{K.TICK_MINUTES} minutes")
    return shifted.groupBy("slug", window.alias("w")).agg(F.count(F.lit(1)).alias("fires")).select("slug", c("w.end").alias("tick"), "fires")


PRICE_STATE = "below boolean, last_run timestamp"
PRICE_OUT = "slug string, rule_pos int, fingerprint string, run_ts timestamp, price double, fires boolean, armed_after boolean, late boolean"


def _price_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Runs of one rule in time order; state is whether the last run was below the threshold."""
    slug, rule_pos, fingerprint = key
    rows = pd.concat(list(frames)).sort_values("run_ts")
    below, last = state.get if state.exists else (False, None)
    out = []
    for r in rows.itertuples(index=False):
        if last is not None and pd.Timestamp(r.run_ts) <= pd.Timestamp(last):
            out.append((slug, rule_pos, fingerprint, r.run_ts, r.price, False, not below, True))
            continue
        now = bool(pd.notna(r.price) and r.price < r.threshold_usd)
        fires = now and (r.mode == "while_below" or not below)
        out.append((slug, rule_pos, fingerprint, r.run_ts, r.price, fires, not now, False))
        below, last = now, r.run_ts
    state.update((below, last))
    yield pd.DataFrame(out, columns=["slug", "rule_pos", "fingerprint", "run_ts", "price", "fires", "armed_after", "late"])


def price_alert_stream(rule_runs: DataFrame) -> DataFrame:
    """rule_runs: slug, rule_pos, fingerprint, mode, threshold_usd, run_ts, price (one row per rule and run).

    The fingerprint is part of the key, so an edited rule starts armed. A run no newer than the last one
    seen fires nothing and comes out with `late` set, for the batch twin to settle.
    """
    return rule_runs.groupBy("slug", "rule_pos", "fingerprint").applyInPandasWithState(
        _price_step, PRICE_OUT, PRICE_STATE, "append", GroupStateTimeout.NoTimeout
    )


def settle_late(stream_out: DataFrame, rule_runs: DataFrame) -> DataFrame:
    """What the price stream would have written had its late runs come in order.

    *stream_out*: rows of price_alert_stream; *rule_runs*: all its input so far, late runs included. For a rule with
    late runs, the runs from the first late one on are evaluated again (each needs only the run before it) and take
    the place of what the stream wrote for them; everything else is kept. Applying it twice changes nothing.
    """
    keys = ["slug", "rule_pos", "fingerprint"]
    since = stream_out.where("late").groupBy(*keys).agg(F.min("run_ts").alias("_since"))
    known = rule_runs.dropDuplicates([*keys, "run_ts"]).join(since, keys)
    w = Window.partitionBy(*keys).orderBy("run_ts")
    below = F.coalesce(c("price") < c("threshold_usd"), F.lit(False))
    was = F.coalesce(F.lag("_below").over(w), F.lit(False))
    again = known.withColumn("_below", below).withColumn("fires", c("_below") & ((c("mode") == "while_below") | ~was)).where(c("run_ts") >= c("_since"))
    again = again.select(*keys, "run_ts", "price", "fires", (~c("_below")).alias("armed_after"), F.lit(False).alias("late"))
    kept = stream_out.where(~c("late")).join(since, keys, "left").where(c("_since").isNull() | (c("run_ts") < c("_since"))).drop("_since")
    return kept.unionByName(again)


HOST_STATE = "hosts array<string>, last_run timestamp"
HOST_OUT = "slug string, run_ts timestamp, host string, late boolean"


def _host_step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Host sets of one product's runs in time order; state is the previous run's set."""
    known, last = (set(state.get[0]), state.get[1]) if state.exists else (set(), None)
    rows = pd.concat(list(frames)).sort_values("run_ts")
    out = []
    for r in rows.itertuples(index=False):
        if last is not None and pd.Timestamp(r.run_ts) <= pd.Timestamp(last):
            out.append((key[0], r.run_ts, None, True))
            continue
        now = set(r.hosts)
        out.extend((key[0], r.run_ts, h, False) for h in sorted(now - known))
        known, last = now, r.run_ts
    state.update((sorted(known), last))
    yield pd.DataFrame(out, columns=["slug", "run_ts", "host", "late"])


def host_arrival_stream(host_runs: DataFrame) -> DataFrame:
    """host_runs: slug, run_ts, hosts (one row per run). Emits hosts that the previous run did not have.

    A run no newer than the last one seen comes out as one row without host and with `late` set.
    """
    return host_runs.groupBy("slug").applyInPandasWithState(_host_step, HOST_OUT, HOST_STATE, "append", GroupStateTimeout.NoTimeout)

class _Hosts(StatefulProcessor):
    """Per product: the newest run, and of each host the run that saw it last. Entries end with the host or the product."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "run_ts timestamp")
        self.seen = handle.getMapState("seen", "host string", "run_ts timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Every call of a state variable is a round trip to the JVM: entries are read once, and only those that differ are written."""
        slug, runs = key[0], {}
        for frame in rows:
            for run, host, gone in zip(frame["run_ts"], frame["host"], frame["gone"]):
                if not pd.isna(run):
                    runs.setdefault((run, gone), set()).add(host)
        newest = self.last.get()
        last = pd.Timestamp(newest[0]) if newest is not None else None
        stored = {k[0]: pd.Timestamp(at[0]) for k, at in self.seen.iterator()} if last is not None else {}
        seen, out, known = dict(stored), [], last
        for run, gone in sorted(runs):
            if gone:
                seen, last = {}, None
                continue
            if last is not None and run <= last:
                out.append((slug, run, None, True))
                continue
            previous, last = last, run
            for host in sorted(h for h in runs[run, gone] if not pd.isna(h)):
                if previous is None or host not in seen or seen[host] < previous:
                    out.append((slug, run, host, False))
                seen[host] = run
        if last is None:
            if known is not None:
                self.last.clear()
        elif last != known:
            self.last.update((last.to_pydatetime(),))
        kept = {h for h, at in seen.items() if at == last}
        if stored and not kept & stored.keys():
            self.seen.clear()
        else:
            for host in stored.keys() - kept:
                self.seen.removeKey((host,))
        for host in kept:
            if stored.get(host) != last:
                self.seen.updateValue((host,), (last.to_pydatetime(),))
        if out:
            yield pd.DataFrame(out, columns=["slug", "run_ts", "host", "late"])

    def close(self) -> None:
        pass


class _Prices(StatefulProcessor):
    """Per rule: whether its last run was below the threshold. The state ends with the rule."""

    def init(self, handle) -> None:
        self.state = handle.getValueState("state", PRICE_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        below, last = self.state.get() if self.state.exists() else (False, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["run_ts", "gone"]).itertuples(index=False):
            run = pd.Timestamp(r.run_ts)
            if r.gone:
                self.state.clear()
                below, last = False, None
                continue
            if last is not None and run <= pd.Timestamp(last):
                out.append((*key, run, r.price, False, not below, True))
                continue
            now = bool(pd.notna(r.price) and r.price < r.threshold_usd)
            out.append((*key, run, r.price, now and (r.mode == "while_below" or not below), not now, False))
            below, last = now, run
        if last is not None:
            self.state.update((below, pd.Timestamp(last).to_pydatetime()))
        yield pd.DataFrame(out, columns=["slug", "rule_pos", "fingerprint", "run_ts", "price", "fires", "armed_after", "late"])

    def close(self) -> None:
        pass


def _with_states(rows: DataFrame, keys: list[str], processor: StatefulProcessor, out: str) -> DataFrame:
    """Several state variables per key need the RocksDB store; it is set for the session, before the query starts."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return rows.groupBy(*keys).transformWithStateInPandas(processor, out, "Append", "None")


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ending_price_alerts(rule_runs: DataFrame) -> DataFrame:
    """price_alert_stream over rows that also have `gone`: such a row ends the state of its rule after the runs up to its run_ts.

    An edited rule has a new fingerprint, so its old one gets a `gone` row. A rule that comes back starts armed.
    A null `gone` is not gone.
    """
    rows = rule_runs.withColumn("gone", F.coalesce("gone", F.lit(False)))
    return _with_states(rows, ["slug", "rule_pos", "fingerprint"], _Prices(), PRICE_OUT)


def ending_host_arrivals(host_rows: DataFrame) -> DataFrame:
    """host_rows: slug, run_ts, host, gone; one row per run and host, a null host for a run without any.

    Emits hosts that the product's previous run did not have, as host_arrival_stream does, but a run touches only the
    entries of its own hosts, hosts that the newest run lacks lose theirs, and a `gone` row ends the product's state
    after the runs up to its run_ts. A run must arrive within one batch; what arrives later comes out as one row
    without host and with `late` set. A batch holds one product's new runs in memory, so maxFilesPerTrigger bounds it.
    """
    rows = host_rows.withColumn("gone", F.coalesce("gone", F.lit(False)))
    return _with_states(rows, ["slug"], _Hosts(), HOST_OUT)


def alert_writer(path: str, deliver=None):
    """foreachBatch function: fired alerts with their delivery outcome, one folder per batch, so a replay overwrites itself.

    *deliver* is an injected function (batch DataFrame -> DataFrame with `outcome`); without it the outcome is 'ok'.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        fired = batch.where("fires") if "fires" in batch.columns else batch
        done = deliver(fired) if deliver else fired.withColumn("outcome", F.lit("ok"))
        done.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def fired_once(due: DataFrame, stored: DataFrame | None) -> DataFrame:
    """One-shot runs to launch now: due ones without a stored marker."""
    once = due.where(c("reason") == "run_at").select("slug", "tick").distinct()
    return once if stored is None else once.join(stored.select("slug").distinct(), "slug", "left_anti")
