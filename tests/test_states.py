"""Relative ranks, mergeable states, table versions, and stream state that ends."""

import random
from datetime import date, datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from offerloom.operators import sketches, skew
from offerloom.sources import versions
from offerloom.streaming import runs as streams
from test_runs import drain

c = F.col


def test_relative_ranks_with_ties_nulls_and_one_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 5 else rng.choice(["a", "b"]), rng.choice([None, 1.0, 1.0, 2.0, rng.random()]), i) for i in range(500)]
    rows += [("single", 3.0, 900), (None, 1.0, 901)]
    got = {r.no: (r.percent_rank, r.cume_dist, r.tile) for r in skew.relative_ranks(spark.createDataFrame(rows, "k string, v double, no int"), ["k"], "v", [c("no")], 7).collect()}
    assert len(got) == len(rows)
    for key in {k for k, _, _ in rows}:
        held = sorted((v, no) for k, v, no in rows if k == key and v is not None and key is not None)
        size, more = divmod(len(held), 7)
        tiles = [t + 1 for t in range(7) for _ in range(size + (t < more))]
        for at, (v, no) in enumerate(held):
            less, upto = sum(x < v for x, _ in held), sum(x <= v for x, _ in held)
            assert got[no] == (less / (len(held) - 1) if len(held) > 1 else 0.0, upto / len(held), tiles[at])
    assert all(got[no] == (None, None, None) for k, v, no in rows if k is None or v is None)
    assert skew.relative_ranks(spark.createDataFrame([], "k string, v double, no int"), ["k"], "v", [c("no")], 3).count() == 0


def test_states_merge_to_one_sketch_over_all_rows(spark):
    rows = [("p", d, f"v{(i * 7919 + d) % 3000}" if i % 10 else None, float((i * 31 + d) % 977) if i % 9 else None) for d in range(10) for i in range(2000)]
    rows += [("empty", 0, None, None)]
    df = spark.createDataFrame(rows, "slug string, day int, vendor string, unit_price_usd double")
    wanted = {"low": 0.1, "mid": 0.5}
    merged = sketches.estimates(sketches.merge_states(sketches.day_states(df, ["slug", "day"], c("vendor")), ["slug"]), wanted)
    got = {r.slug: r for r in merged.collect()}
    assert (got["p"].offers, got["p"].priced) == (20000, sum(r[3] is not None for r in rows))
    assert (got["empty"].vendors, got["empty"].low, got["empty"].mid) == (0, None, None)
    errors = {r.slug: r for r in sketches.estimate_errors(df, ["slug"], c("vendor"), merged, wanted).collect()}
    assert errors["p"].exact_vendors == len({r[2] for r in rows if r[2]}) and errors["p"].vendor_error < 0.04 and errors["p"].rank_error < 0.02
    assert (errors["empty"].exact_vendors, errors["empty"].vendor_error, errors["empty"].rank_error) == (0, 0.0, None)


SCHEMA = "k int, v string, snapshot_date date"


def stored(spark, path, schema, seq=None):
    return sorted((r.k, r.v, r.snapshot_date and r.snapshot_date.day) for r in versions.read(spark, path, schema, seq).collect())


def test_versions_switch_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda *rows: spark.createDataFrame([(k, v, d and date(2026, 1, d)) for k, v, d in rows], SCHEMA)
    schema = frame((1, "a", 1)).schema
    with pytest.raises(LookupError):
        versions.read(spark, path, schema)
    assert versions.publish(spark, frame((1, "a", 1), (2, "b", 2), (3, "c", None)), path) == 1
    assert versions.publish(spark, frame((4, "d", 2), (5, "e", None)), path, lambda old, new: old.unionByName(new)) == 2
    second = [(1, "a", 1), (2, "b", 2), (3, "c", None), (4, "d", 2), (5, "e", None)]
    assert stored(spark, path, schema) == second
    # A writer that fails over the second of its days leaves nothing visible.
    bad = frame((6, "x", 1), (7, "y", 2)).withColumn("v", F.when(c("k") == 7, F.raise_error(F.lit("lost")).cast("string")).otherwise(c("v")))
    with pytest.raises(Exception, match="lost"):
        versions.publish(spark, bad, path)
    fail = lambda old, new: new.withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        versions.publish(spark, frame((6, "x", 1)), path, fail)
    # Neither does one that dies after its rows and before its list.
    frame((8, "z", 1)).write.partitionBy("snapshot_date").parquet(f"{path}/data/version=dead")
    assert stored(spark, path, schema) == second and versions.newest(spark, path) == 2
    assert versions.publish(spark, frame((9, "i", 1)), path) == 3
    assert stored(spark, path, schema) == [(2, "b", 2), (3, "c", None), (4, "d", 2), (5, "e", None), (9, "i", 1)]
    assert stored(spark, path, schema, 2) == second
    assert stored(spark, path, schema, 1) == [(1, "a", 1), (2, "b", 2), (3, "c", None)]
    # Days that a merge empties leave the table; an empty batch keeps the days.
    assert versions.publish(spark, frame((9, "i", 1)), path, lambda old, new: new.limit(0)) == 4
    assert versions.publish(spark, frame((9, "i", 1)).limit(0), path) == 5
    assert stored(spark, path, schema) == [(2, "b", 2), (3, "c", None), (4, "d", 2), (5, "e", None)]


def test_first_version_may_be_empty(spark, tmp_path):
    path = str(tmp_path / "t")
    empty = spark.createDataFrame([], SCHEMA)
    assert versions.publish(spark, empty, path) == 1
    assert stored(spark, path, empty.schema) == []


def test_host_state_ends_with_hosts_and_products(spark, tmp_path):
    ddl = "slug string, run_ts timestamp, host string, gone boolean"
    src, home = str(tmp_path / "in"), str(tmp_path / "q")

    def step(*rows):
        spark.createDataFrame([(s, datetime(2026, 1, d), h, g) for s, d, h, g in rows], ddl).write.mode("append").parquet(src)
        out = drain(spark, streams.ending_host_arrivals(spark.readStream.schema(ddl).parquet(src)), home)
        return sorted((r.slug, r.run_ts.day, r.host or "", r.late) for r in out.collect())

    def entries(variable):
        return spark.read.format("statestore").option("path", f"{home}/c").option("stateVarName", variable).load().count()

    first = [("p", 1, "a", False), ("p", 1, "b", False), ("q", 1, "a", False)]
    assert step(("p", 1, "a", None), ("p", 1, "b", False), ("q", 1, "a", False)) == first
    assert (entries("last"), entries("seen")) == (2, 3)
    # b is missing for a run and comes back; a late run is marked.
    second = sorted([*first, ("p", 3, "b", False), ("p", 1, "", True)])
    assert step(("p", 2, "a", False), ("p", 3, "a", False), ("p", 3, "b", False), ("p", 1, "c", False)) == second
    assert entries("seen") == 3
    # A run without hosts ends the entries of its product; a gone product ends all its state and starts anew.
    assert step(("p", 4, None, False), ("q", 4, None, True)) == second
    assert (entries("last"), entries("seen")) == (1, 0)
    assert step(("q", 5, "a", False), ("p", 5, "a", False)) == sorted([*second, ("q", 5, "a", False), ("p", 5, "a", False)])


def test_price_state_ends_with_its_rule(spark, tmp_path):
    ddl = "slug string, rule_pos int, fingerprint string, mode string, threshold_usd double, run_ts timestamp, price double, gone boolean"
    src, home = str(tmp_path / "in"), str(tmp_path / "q")
    counts = []
    for day, price, gone in [(1, 90.0, False), (2, 80.0, None), (3, None, True), (4, 95.0, False), (4, 95.0, False)]:
        spark.createDataFrame([("p", 0, "f", "is_below", 100.0, datetime(2026, 1, day), price, gone)], ddl).write.mode("append").parquet(src)
        out = drain(spark, streams.ending_price_alerts(spark.readStream.schema(ddl).parquet(src)), home)
        counts.append(spark.read.format("statestore").option("path", f"{home}/c").option("stateVarName", "state").load().count())
    assert counts == [1, 1, 0, 1, 1]
    assert sorted((r.run_ts.day, r.fires, r.late) for r in out.collect()) == [(1, True, False), (2, False, False), (4, False, True), (4, True, False)]


class _Cell:
    """A state variable that counts its calls, each of which is a round trip to the JVM."""

    def __init__(self, calls, items=()):
        self.calls, self.items = calls, dict(items)

    def __getattr__(self, name):
        def call(*args):
            self.calls.append(name)
            if name == "get":
                return self.items.get(0)
            if name == "iterator":
                return iter([((k,), (v,)) for k, v in self.items.items()])
            if name == "clear":
                self.items.clear()
            if name == "removeKey":
                del self.items[args[0][0]]
            if name == "update":
                self.items[0] = args[0]
            if name == "updateValue":
                self.items[args[0][0]] = args[1][0]

        return call


def test_host_state_is_read_once_and_written_where_it_differs():
    calls = []
    hosts = streams._Hosts()
    hosts.last, hosts.seen = _Cell(calls), _Cell(calls)

    def step(*rows):
        calls.clear()
        frame = pd.DataFrame([(pd.Timestamp(2026, 1, d) if d else pd.NaT, h, g) for d, h, g in rows], columns=["run_ts", "host", "gone"])
        return [(r.run_ts.day, r.host, r.late) for f in hosts.handleInputRows(("p",), iter([frame]), None) for r in f.itertuples()]

    many = [(d, h, False) for d in range(1, 21) for h in "abc"]
    assert step(*many, (None, "x", False)) == [(1, h, False) for h in "abc"] and sorted(hosts.seen.items) == ["a", "b", "c"]
    assert len(calls) <= 6
    assert step((5, "z", False)) == [(5, None, True)] and len(calls) <= 2
    assert step((21, "c", False), (22, "c", False), (22, "d", False)) == [(22, "d", False)] and sorted(hosts.seen.items) == ["c", "d"]
    # A product that ends and comes back with the run it had: all its hosts are new, its entries are those of that run.
    assert step((2, None, True), (22, "e", False)) == [(22, "e", False)] and sorted(hosts.seen.items) == ["e"]
    assert step((30, None, True)) == [] and not hosts.seen.items and not hosts.last.items
