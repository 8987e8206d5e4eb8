import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gradeline.operators import ledger, prefix


def skewed(seed, n=600):
    """(run, time, seq, cost): one run and one moment hold a third of the rows each."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        run = "hot" if rng.random() < 0.4 else f"r{rng.randint(0, 9)}"
        run = None if run in ("r0", "r1") else run
        time = 50.0 if rng.random() < 0.35 else rng.random() * 100
        rows.append((run, time, seq, rng.randint(0, 5)))
    return rows


def brute(rows):
    spent, out = {}, {}
    for run, time, seq, cost in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        out[seq] = spent.get(run, 0)
        spent[run] = out[seq] + cost
    return out


@pytest.fixture(params=["one block", "many blocks"], autouse=True)
def path(request, monkeypatch):
    """Every test runs over one block and, with small ones, over many."""
    if request.param == "many blocks":
        monkeypatch.setattr(prefix, "BLOCK_ROWS", 5)


@pytest.mark.parametrize("seed,partitions", [(1, 1), (1, 7), (2, 3)])
def test_prefix_sums_any_partitioning(spark, seed, partitions):
    rows = skewed(seed)
    df = spark.createDataFrame(rows, "run STRING, time DOUBLE, seq BIGINT, cost BIGINT").repartition(partitions)
    got = prefix.prefix_sums(df, {"before": "cost"}, ["time", "seq"], within=["run"])
    assert {r.seq: r.before for r in got.collect()} == brute(rows)
    assert got.columns == ["run", "time", "seq", "cost", "before"] or set(got.columns) == {"run", "time", "seq", "cost", "before"}


def test_prefix_sums_split_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BLOCK_ROWS", 500)
    seen = []
    whole = prefix.sums_over_blocks
    monkeypatch.setattr(prefix, "sums_over_blocks", lambda df, *a, **k: seen.append(df) or whole(df, *a, **k))
    df = spark.range(4000).select(F.lit("one").alias("run"), "id")
    got = prefix.prefix_sums(df, {"rank": F.lit(1)}, ["id"], within=["run"])
    assert got.where("rank <> id").count() == 0
    sizes = [r["count"] for r in seen[0].groupBy(prefix.BLOCK).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1000


def test_opening_balances_of_every_run(spark):
    calls = spark.createDataFrame([(None, 1, Decimal(1)), (None, 2, Decimal(2)), ("a", 3, Decimal(1)), ("b", 4, Decimal(1))], "run STRING, seq BIGINT, mtok DECIMAL(28,9)")
    opening = spark.createDataFrame([(None, Decimal(5)), ("a", Decimal(7)), ("gone", Decimal(9))], "run STRING, opening DECIMAL(28,9)")
    got = {r.seq: int(r.spent_after) for r in ledger.running_ledger(calls, 100, ["seq"], opening=opening).collect()}
    assert got == {1: 6, 2: 8, 3: 8, 4: 1}


def test_prefix_sums_without_groups(spark):
    df = spark.range(1000).repartition(6)
    assert prefix.prefix_sums(df, {"rank": F.lit(1)}, ["id"]).where("rank <> id").count() == 0


def test_running_ledger(spark):
    rows = skewed(3)
    df = spark.createDataFrame([(r, t, s, Decimal(c) / 10) for r, t, s, c in rows], "run STRING, time DOUBLE, seq BIGINT, mtok DECIMAL(28,9)")
    got = {r.seq: r for r in ledger.running_ledger(df, "2.5", ["time", "seq"]).collect()}
    for seq, before in brute(rows).items():
        row = got[seq]
        assert row.spent_before == Decimal(before) / 10
        assert row.spent_after + row.remaining == Decimal("2.5")
        assert row.exhausted == (row.spent_after >= Decimal("2.5"))


def test_unbilled_calls_change_nothing(spark):
    df = spark.createDataFrame([("a", 1, Decimal("0.5")), ("a", 2, None), ("a", 3, Decimal("0.25"))], "run STRING, seq BIGINT, mtok DECIMAL(28,9)")
    got = [r.spent_after for r in ledger.running_ledger(df, 1, ["seq"]).orderBy("seq").collect()]
    assert got == [Decimal("0.5"), Decimal("0.5"), Decimal("0.75")]


def cut(spark, costs, budget, **kw):
    df = spark.createDataFrame([("r", i, Decimal(str(c))) for i, c in enumerate(costs)], "run STRING, idx BIGINT, mtok DECIMAL(28,9)")
    return ledger.budget_cut(df.repartition(3), budget, **kw).orderBy("idx").collect()


def test_budget_cut_keeps_the_crossing_row(spark):
    rows = cut(spark, [2, 2, 2, 2], 5)
    assert [r.idx for r in rows] == [0, 1, 2] and [r.stopped_early for r in rows] == [False, False, True]


def test_budget_cut_is_exact(spark):
    rows = cut(spark, [0.1] * 12, "1.0")
    assert len(rows) == 10 and rows[-1].stopped_early


def test_budget_cut_without_budget_and_with_initial(spark):
    assert len(cut(spark, [2, 2, 2], None)) == 3
    assert [r.idx for r in cut(spark, [2, 2, 2], 5, initial=3)] == [0]
    assert cut(spark, [2, 2], 5, initial=5) == []


def test_budget_cut_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BLOCK_ROWS", 4)
    rng = random.Random(4)
    rows = [(f"r{rng.randint(0, 1)}", i, rng.randint(0, 3)) for i in range(200)]
    df = spark.createDataFrame([(r, i, Decimal(c)) for r, i, c in rows], "run STRING, idx BIGINT, mtok DECIMAL(28,9)")
    got = {r.idx for r in ledger.budget_cut(df.repartition(5), 60).collect()}
    expected, spent = set(), {}
    for run, i, cost in rows:
        if spent.get(run, 0) < 60:
            expected.add(i)
        spent[run] = spent.get(run, 0) + cost
    assert got == expected


def test_first_exhausted_is_once_per_run(spark):
    rows = skewed(5)
    df = spark.createDataFrame([(r, t, s, Decimal(c)) for r, t, s, c in rows], "run STRING, time DOUBLE, seq BIGINT, mtok DECIMAL(28,9)")
    hits = ledger.first_exhausted(ledger.running_ledger(df, 20, ["time", "seq"]), 20).collect()
    totals = {}
    for run, _, _, cost in rows:
        totals[run] = totals.get(run, 0) + cost
    assert sorted(str(r.run) for r in hits) == sorted(str(r) for r, t in totals.items() if t >= 20)


def test_statuses(spark):
    df = spark.createDataFrame([("a", 60.0, Decimal("0.5")), ("a", 240.0, Decimal("0.75")), ("b", 5.0, None)], "run STRING, time DOUBLE, mtok DECIMAL(28,9)")
    spent = {r.run: r for r in ledger.budget_status(df, 1).collect()}
    assert spent["a"].remaining_mtok == Decimal("-0.25") and spent["a"].exhausted and spent["b"].spent_mtok == 0
    used = {r.run: r for r in ledger.time_status(df, 10).collect()}
    assert (used["a"].used_time_min, used["a"].remaining_time_min) == (3.0, 7.0)


def test_every_core_gets_a_block_of_many_rows(spark, monkeypatch):
    most, least = 1 << 20, prefix.LEAST_ROWS
    monkeypatch.setattr(prefix, "BLOCK_ROWS", most)
    assert [prefix.block_count(n, 12) for n in (0, 1, least, 3 * least, most, 30 * most)] == [1, 1, 1, 3, 12, 30]
    monkeypatch.setattr(prefix, "LEAST_ROWS", 10)
    monkeypatch.setattr(prefix, "pin", lambda df, name: pinned.append(df.localCheckpoint()) or pinned[-1])
    pinned = []
    rows = spark.range(100).select((F.col("id") % 3).alias("g"), "id")
    got = {r.id: r.s for r in prefix.prefix_sums(rows, {"s": "id"}, ["id"], ["g"]).collect()}
    assert got == {i: sum(range(i % 3, i, 3)) for i in range(100)}
    cores = spark.sparkContext.defaultParallelism
    assert pinned[-1].select(prefix.BLOCK).distinct().count() == min(cores, 10)
