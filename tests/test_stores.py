"""Filters ahead of joins, mergeable medians, and the committing store."""

import random

import pytest
from pyspark.sql import functions as F
from support import packets, plan, rows, udp

from floodlens.functions import semijoin
from floodlens.operators import alerts, attack
from floodlens.sources.ledger import LedgerWriter, ledger_read, ledger_write


# Filters ahead of joins --------------------------------------------------------------------------

def _keys(spark, count, offset=0):
    return spark.range(count).select((F.col("id") + offset).cast("string").alias("src"),
                                     (F.col("id") % 7).cast("int").alias("sport"))


def test_filter_keeps_all_matches_and_few_others(spark):
    small, large = _keys(spark, 5000), _keys(spark, 60_000)
    kept = semijoin.only_possible(large, small, ["src", "sport"])
    assert kept.join(small, ["src", "sport"]).count() == 5000
    assert 5000 <= kept.count() < 5000 + 0.03 * 55_000
    assert rows(semijoin.only_possible(large, small.limit(0), ["src"])) == []


def test_filter_size_follows_the_keys_up_to_a_bound(spark, monkeypatch):
    assert semijoin.filter_bits(0) == 32_768
    assert semijoin.filter_bits(10_000) >= 160_000 and semijoin.filter_bits(10_000) % 32_768 == 0
    assert semijoin.filter_bits(semijoin.MOST_BITS) == 0
    bits = semijoin.filter_bits(10_000)
    (row,) = semijoin.key_filter(_keys(spark, 10_000), ["src"], bits).collect()
    assert len(row.bits) == bits // 8
    monkeypatch.setattr(semijoin, "MOST_BITS", 1)
    large = _keys(spark, 10)
    assert semijoin.only_possible(large, large, ["src"]) is large


def test_fewer_rows_of_the_large_side_are_shuffled(spark):
    """Rows that pass the filter below the shuffle, counted by an accumulator."""
    ends = "src string, sport int, dst string, dport int"
    raised = spark.createDataFrame([("a", i, "b", 80, 1, "m", 1, "s") for i in range(20)],
                                   ends + ", ts long, message string, priority int, sig string")
    headers = spark.range(20_000).selectExpr(
        "'a' as src", "cast(id as int) as sport", "'b' as dst", "80 as dport", "'f' as field")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    kept = semijoin.only_possible(headers, raised, alerts.ENDPOINTS)
    kept.mapInArrow(count, kept.schema).collect()
    assert 20 <= seen.value < 300
    found = alerts.attacker_useragents(raised, headers)
    assert rows(found) == [("f", 20)]
    text = plan(found)
    assert text.index("Subquery") > 0 and "xxhash64" in text


# Medians ---------------------------------------------------------------------------------------

def test_sketched_medians_are_near_the_exact_ones(spark):
    rng = random.Random(6)
    lengths = {f"s{s}": [int(rng.paretovariate(1.2) * 40) % 1500 for _ in range(n)]
               for s, n in enumerate((1, 2, 300, 20_000))}
    frame = packets(spark, [udp(rng.randrange(100), s, length=n)
                            for s, held in lengths.items() for n in held]).repartition(5)
    halves = [attack.length_sketches(frame.where(f"ts % 2 = {i}"), 10, filtered=True)
              for i in (0, 1)]
    merged = attack.sketched_medians(halves[0].unionByName(halves[1])).collect()
    assert {r.src_ip: r.n for r in merged} == {s: len(held) for s, held in lengths.items()}
    for r in merged:
        held = sorted(lengths[r.src_ip])
        below = sum(x < r.pkt_length_median for x in held) / len(held)
        upto = sum(x <= r.pkt_length_median for x in held) / len(held)
        assert below - 0.025 <= 0.5 <= upto + 0.025 or len(held) <= 2


# The committing store ------------------------------------------------------------------------------

SCHEMA = "key long, value string"


def _frame(spark, values, parts=2):
    return spark.createDataFrame(list(values.items()), SCHEMA).repartition(parts)


def test_later_jobs_win_and_repeated_ones_replace_themselves(spark, tmp_path):
    path = str(tmp_path / "store")
    assert rows(ledger_read(spark, path, SCHEMA, ["key"])) == []
    ledger_write(_frame(spark, {1: "a", 2: "a", 3: "a"}), path, "one")
    ledger_write(_frame(spark, {2: "b", 4: "b"}), path, "two")
    ledger_write(_frame(spark, {}), path, "none")
    assert rows(ledger_read(spark, path, SCHEMA, ["key"])) == [
        (1, "a"), (2, "b"), (3, "a"), (4, "b")]
    ledger_write(_frame(spark, {2: "c", 5: "c"}), path, "one")  # again, with other rows
    assert rows(ledger_read(spark, path, SCHEMA, ["key"])) == [(2, "c"), (4, "b"), (5, "c")]


def test_a_failed_job_leaves_nothing_and_a_repeated_task_one_row(spark, tmp_path):
    path, marker = str(tmp_path / "store"), tmp_path / "failed"
    ledger_write(_frame(spark, {1: "old"}), path, "base")

    def breaks(batches):
        for batch in batches:
            yield batch
        raise RuntimeError("task lost")

    broken = _frame(spark, {1: "new", 2: "new"}, 1).mapInArrow(breaks, SCHEMA)
    with pytest.raises(Exception, match="task lost"):
        ledger_write(broken, path, "job")
    assert rows(ledger_read(spark, path, SCHEMA, ["key"])) == [(1, "old")]
    ledger_write(_frame(spark, {1: "new", 2: "new"}, 1), path, "job")
    assert rows(ledger_read(spark, path, SCHEMA, ["key"])) == [(1, "new"), (2, "new")]
    # Two attempts of one task both write; only the accepted one is in the manifest.
    writer = LedgerWriter(path, "attempts")
    batch = _frame(spark, {7: "x"}, 1).toArrow().to_batches()
    writer.write(iter(batch))
    writer.commit([writer.write(iter(batch)), None])
    assert rows(ledger_read(spark, path, SCHEMA, ["key"]))[-1] == (7, "x")
    assert not marker.exists() and len(list((tmp_path / "store" / "rows").iterdir())) >= 4


def test_job_names_are_checked(spark, tmp_path):
    with pytest.raises(Exception, match="not the name of a job"):
        ledger_write(_frame(spark, {1: "a"}), str(tmp_path / "s"), "../up")
