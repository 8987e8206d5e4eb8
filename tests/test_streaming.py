import json
import random
from decimal import Decimal

import pytest

from gradeline.operators import prefix
from gradeline.operators.ledger import first_exhausted, running_ledger
from gradeline.streaming.ledger import ORDER, LedgerStream, metered, read_call_log, spend_totals
from gradeline.streaming.requests import read_request_log, request_totals
from gradeline.streaming.keyed import KeyedTable, cover
from gradeline.streaming.sinks import append_output, read_totals, write_totals


def call(rng, seq):
    usage = {"prompt_tokens": rng.randint(100, 900) * 1000, "completion_tokens": 5, "prompt_tokens_details": {"cached_tokens": 10, "cache_write_tokens": 0}}
    status = 500 if rng.random() < 0.1 else 200
    body = "" if rng.random() < 0.1 else json.dumps({"usage": usage})
    return {"time": 1000.0 + seq // 3, "run": "hot" if rng.random() < 0.4 else (None, "r1", "r2", "r3")[seq % 4], "seq": seq, "model": "m", "path": "/p", "status_code": status, "request": "{}", "response": body}


def write(path, calls):
    path.write_text("".join(json.dumps(c) + "\n" for c in calls))


@pytest.mark.parametrize("limit", [10, 10**6])
def test_ledger_over_three_runs_equals_batch(spark, tmp_path, monkeypatch, limit):
    monkeypatch.setattr(prefix, "BLOCK_ROWS", limit)
    rng = random.Random(1)
    calls = [call(rng, i) for i in range(120)]
    log = tmp_path / "log"
    log.mkdir()
    stream = LedgerStream(str(tmp_path / "out"), "6")
    for part in range(3):  # files arrive in time order, one run of the stream after each
        write(log / f"{part}.json", calls[part * 40 : part * 40 + 40])
        stream.run(read_call_log(spark, str(log)))
    stream.run(read_call_log(spark, str(log)))  # nothing new
    got = {(r.run, r.seq): (r.spent_before, r.spent_after, r.exhausted) for r in stream.ledger(spark).collect()}
    batch = running_ledger(metered(spark.read.schema(read_call_log(spark, str(log)).schema).json(str(log))), "6", ORDER)
    rows = batch.collect()
    assert got == {(r.run, r.seq): (r.spent_before, r.spent_after, r.exhausted) for r in rows} and len(got) == 120
    signals = sorted((str(r.run), r.seq) for r in stream.exhausted(spark).collect())
    assert signals == sorted((str(r.run), r.seq) for r in first_exhausted(batch, "6").collect()) and signals


def test_the_stream_leaves_no_scratch(spark, tmp_path):
    from pathlib import Path

    from gradeline.session import fresh_path

    def held():
        return {p for p in Path(fresh_path(spark, "x")).parent.glob("*") if p.is_dir()}

    (tmp_path / "log").mkdir()
    write(tmp_path / "log" / "0.json", [call(random.Random(4), i) for i in range(30)])
    before = held()
    LedgerStream(str(tmp_path / "out"), 6).run(read_call_log(spark, str(tmp_path / "log")))
    assert held() == before


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    rng = random.Random(2)
    (tmp_path / "log").mkdir()
    write(tmp_path / "log" / "0.json", [call(rng, i) for i in range(30)])
    calls = spark.read.schema(read_call_log(spark, str(tmp_path / "log")).schema).json(str(tmp_path / "log"))
    stream = LedgerStream(str(tmp_path / "out"), 6)
    stream.handle(calls, 0)
    stream.handle(calls.where("seq >= 20"), 1)
    before = sorted(map(str, stream.ledger(spark).collect()))
    stream.handle(calls.where("seq >= 20"), 1)
    assert sorted(map(str, stream.ledger(spark).collect())) == before


def test_spend_totals_grow(spark, tmp_path):
    rng = random.Random(3)
    (tmp_path / "log").mkdir()
    calls = [call(rng, i) for i in range(60)]
    for part in range(2):
        write(tmp_path / "log" / f"{part}.json", calls[part * 30 : part * 30 + 30])
        stream = spend_totals(read_call_log(spark, str(tmp_path / "log"), files_per_batch=1))
        write_totals(stream, str(tmp_path / "totals"), str(tmp_path / "ck"), ["run"])
    totals = {r.run: r for r in read_totals(spark, str(tmp_path / "totals"), ["run"]).collect()}
    assert sum(r.n_calls for r in totals.values()) == 60
    billed = [c for c in calls if c["status_code"] == 200 and c["response"]]
    assert sum(r.n_billed for r in totals.values()) == len(billed)
    tokens = sum(json.loads(c["response"])["usage"]["prompt_tokens"] for c in billed)
    # per call: prompt less 10 cached, 5 written twice, a tenth of the cached
    assert sum(r.spent_mtok for r in totals.values()) == Decimal(tokens + len(billed)) / 10**6


def test_request_totals(spark, tmp_path):
    (tmp_path / "log").mkdir()
    urls = ["http://bad.com/x", "http://bad.com/y", "http://localhost/", "http://fine.com/"]
    write(tmp_path / "log" / "0.json", [{"url": u, "status_code": 403 if i < 3 else 200} for i, u in enumerate(urls)])
    keys = ["status_code", "blocked_by", "loopback"]
    write_totals(request_totals(read_request_log(spark, str(tmp_path / "log")), [["bad.com"]]), str(tmp_path / "t"), str(tmp_path / "ck"), keys)
    got = {tuple(r) for r in read_totals(spark, str(tmp_path / "t"), keys).select("status_code", "blocked_by", "loopback", "n").collect()}
    assert got == {(403, 0, False, 2), (403, None, True, 1), (200, None, False, 1)}


def test_output_is_resumed_without_repeats(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for part in range(3):
        write(tmp_path / "in" / f"{part}.json", [{"idx": part * 10 + i} for i in range(10)])
        stream = spark.readStream.schema("idx BIGINT").json(str(tmp_path / "in"))
        append_output(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    assert sorted(r.idx for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(30))


def test_cover_is_every_batch_once():
    def span(last):
        return (last + 1) & -(last + 1)

    for n in range(300):
        held = [b for last in cover(n) for b in range(last - span(last) + 1, last + 1)]
        assert sorted(held) == list(range(n)) and len(cover(n)) == n.bit_count()


def test_keyed_table_keeps_the_newest_row_in_few_files(spark, tmp_path):
    rng, newest, written = random.Random(6), {}, []
    table = KeyedTable(str(tmp_path / "t"), ["key"])
    base = [(k, 0) for k in [None, *map(str, range(40))]]
    for number in range(10):
        rows = base if number == 0 else [(k, number) for k, _ in rng.sample(base, 3)]
        changed = spark.createDataFrame(rows, "key string, value int")
        table.write(changed, number)
        if number in (4, 7):
            table.write(changed, number)  # a repeated batch
        newest.update(rows)
        folders = {int(p.name[6:]) for p in (tmp_path / "t").glob("batch=*")}
        assert folders <= {number, *cover(number)} and len(folders) <= 5
        written.append(spark.read.parquet(str(tmp_path / "t" / f"batch={number}")).count())
        if number in (0, 5, 9):
            assert {r.key: r.value for r in table.current(spark).collect()} == newest
    assert all(n <= 6 for n in written[2::4]) and written[8] == 3  # only what batches touched
