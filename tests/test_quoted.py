"""Quoted CSV in parts: the same rows as a plain reader, however the files are cut."""

import csv
import random

import pytest

from gradeline.sources.readers import read_quoted_csv, read_raw_lines


@pytest.fixture
def small_splits(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(k) for k in keys]
    yield lambda size: [spark.conf.set(k, str(size)) for k in keys]
    for k, v in zip(keys, old):
        spark.conf.set(k, v)


def write(path, names, rows, end="\r\n"):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator=end)
        out.writerow(names)
        out.writerows(rows)


def read(spark, path, names):
    return sorted(tuple(r) for r in read_quoted_csv(spark, str(path), names).collect())


def value(rng):
    parts = ['"', '""', "\n", "\r\n", ",", " ", "a", "é中", "", "\n\n", '"\n"', "word "]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))


@pytest.mark.parametrize("size", [97, 100_000])
def test_same_rows_for_any_cuts(spark, small_splits, tmp_path, size):
    rng = random.Random(size)
    rows = [(str(i), value(rng), value(rng)) for i in range(60)]
    write(tmp_path / "a.csv", ["id", "text", "more"], rows[:40], "\n")
    write(tmp_path / "b.csv", ["more", "id", "text"], [(c, a, b) for a, b, c in rows[40:]])
    write(tmp_path / "c.csv", ["id", "text", "more"], [])
    small_splits(size)
    assert read(spark, tmp_path, ["id", "text", "more"]) == sorted(rows)
    assert read(spark, tmp_path, ["text"]) == sorted((b,) for _, b, _ in rows)


def test_a_break_on_every_cut(spark, small_splits, tmp_path):
    """One record after the other is larger than a split: every cut lies inside a quoted field."""
    rows = [(str(i), ("line, \"quoted\"\n" * 40) + str(i)) for i in range(9)]
    write(tmp_path / "one.csv", ["id", "text"], rows, "\n")
    small_splits(512)
    lines = read_raw_lines(spark, str(tmp_path))
    assert lines.select("block_start").distinct().count() > 8 and lines.rdd.getNumPartitions() > 8
    assert read(spark, tmp_path, ["id", "text"]) == sorted(rows)


def test_blank_lines_and_short_rows(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,text\n\n1,"a\n\nb"\n\n2\n3,\n4,""\n5,"open\nto the end')
    assert read(spark, tmp_path, ["id", "text"]) == [
        ("1", "a\n\nb"), ("2", ""), ("3", ""), ("4", ""), ("5", "open\nto the end")
    ]


def test_no_rows_and_missing_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("")
    assert read(spark, tmp_path, ["id"]) == []
    (tmp_path / "y.csv").write_text("id\n1\n")
    with pytest.raises(ValueError, match="text"):
        read_quoted_csv(spark, str(tmp_path), ["id", "text"])
