"""NULLs, empty and long texts, repeated rows, empty tables and columns with clashing names."""

import pytest

import public_tokenizers
from gradeline.llm import bpe, language, lines, packing, pii, secrets, simhash, sketch, topk, toxicity

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, key string, ids string, fp int, "
    "component int, spans int, `group` int, row int, block int, _near_row int, _line_row int, _pii_text int, hash int"
)
LONG = "lorem ipsum dolor sit amet consectetur " * 5000
DATA = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 63),
    (1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "a", 63),
    (2, "", "en", "b", 0),
    (3, None, None, None, None),
    (None, "El zorro marrón salta sobre el perro perezoso", "es", None, 45),
    (4, " \n\t ", "es", "b", 4),
    (5, LONG, None, "c", len(LONG)),
    (6, "12345 67890 !!!", "en", "c", 15),
    (7, "\U0001f600中文 mail me: joe@site.org or token = abcdef123456", None, "d", 50),
]
ROWS = [(*r, *("x", "y"), *range(10)) for r in DATA]
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def operators(spark, docs):
    codes = language.learn(docs, "text", "lang", 10)
    model = secrets.Ratio(*secrets.samples(docs, "text", 10))
    labels = spark.createDataFrame([(1, 1, 5), (2, 0, 5), (None, 1, 5), (4, None, 5), (5, 7, 5)], "doc_id long, toxic int, text int")
    toxic = toxicity.learn(docs, labels, "doc_id", "text", "toxic", 10)
    tagger = pii.learn(docs, "text", 10, most_windows=40)
    return {
        "language": lambda: language.identify(docs, "doc_id", "text", codes),
        "sketch": lambda: sketch.edited_sketches(docs, "doc_id", "text"),
        "simhash": lambda: simhash.near_groups(docs, "doc_id", "text"),
        "secrets": lambda: secrets.find_secrets(docs, "doc_id", "text", model),
        "personal": lambda: pii.find_personal(docs, "doc_id", "text", tagger),
        "toxicity": lambda: toxicity.score(docs, "doc_id", "text", toxic),
        "bpe": lambda: bpe.round_trip(docs, "doc_id", "text", PATH, public_tokenizers.PATTERN),
        "masked": lambda: pii.mask(docs, "text", tagger, counted="n_chars"),
        "lines": lambda: lines.remove_boilerplate(docs, "text", "source", 2, counted="n_chars"),
    }


def test_every_row_has_a_result(spark, docs):
    for name, run in operators(spark, docs).items():
        rows = run().collect()
        assert len(rows) == len(DATA), name
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in DATA), name


def test_empty_tables(spark, empty):
    for name, run in operators(spark, empty).items():
        assert run().collect() == [], name
    assert language.recognised(empty, "text", language.learn(empty, "text", "lang", 5)).collect() == []
    assert simhash.keep_one(empty, "text", "doc_id").collect() == []
    assert packing.pack(empty, "doc_id", "text", WORDS, 1).collect() == []


def test_filters_keep_columns_and_untouched_values(spark, docs):
    kept = simhash.keep_one(docs, "text", "doc_id")
    assert kept.columns == docs.columns
    rows = kept.collect()
    # the repeated row once; NULL, empty and blank texts are one group, of which the smallest id stays
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 5, 6, 7]
    assert all(tuple(r) in ROWS for r in rows)
    masked = pii.mask(docs, "text", None, counted="n_chars")
    assert masked.columns == docs.columns
    by_id = {r.doc_id: r for r in masked.collect()}
    assert "[EMAIL]" in by_id[7].text and by_id[7].n_chars == len(by_id[7].text)
    assert by_id[3].text is None and by_id[5].text == LONG
    found = language.recognised(docs, "text", language.learn(docs, "text", "lang", 10))
    assert found.columns == docs.columns
    assert not {2, 3, 4, 6} & {r.doc_id for r in found.collect()}


def test_lines_far_and_near_the_threshold(spark):
    rows = [(i, f"own line {i}\n  shared by all \nnear {i % 3} sites\n" + f"body of {i} " * 5, f"s{i % 40}") for i in range(120)]
    rows += [(200, "shared by all", "s1"), (201, None, "s1"), (202, "shared by all\n" + "text " * 9, None)]
    rows += [(203, "shared by all\nnear 1 sites", "s1"), (204, "shared by all\nnear 1 sites", "s2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spread = {r.line: r.sites for r in lines.spread_lines(docs, "text", "source", 20).collect()}
    assert sorted(spread.values())[:3] == [40, 40, 40] and len(spread) == 4
    out = {r.doc_id: r.text for r in lines.remove_boilerplate(docs, "text", "source", 20).collect()}
    assert out[5] == "own line 5\n" + "body of 5 " * 5
    assert out[200] == ""  # nothing else is in it, and no other row is the same
    assert out[203] == out[204] == "shared by all\nnear 1 sites"  # copies of each other stay
    assert out[201] is None and out[202] == "text " * 9


def test_sketches_merge_and_contain(spark):
    long, short = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(100, 400))
    df = spark.createDataFrame([(1, long, short, long + " " + short)], "id int, a string, b string, c string")
    for name in "abc":
        df = sketch.sketched(df, name, f"s{name}", scale=4)
    row = df.select(
        sketch.containment(df.sb, df.sa).alias("inside"), sketch.resemblance(df.sb, df.sa).alias("like"),
        (sketch.merged(df.sa, df.sb, 4) == df.sa).alias("same"), sketch.as_text(df.sa).alias("text"),
    ).first()
    assert row.inside == 1.0 and row.like < 0.15 and row.same and len(row.text) % 16 == 0


def test_next_row_across_buckets(spark, monkeypatch):
    monkeypatch.setattr(sketch, "BUCKET_ROWS", 4)
    keys = [i * i for i in range(300)] + [7, 7, None]
    df = spark.createDataFrame([(k, f"text {n}") for n, k in enumerate(keys)], "doc_id long, text string")
    rows = df.selectExpr("doc_id AS key", "text", "xxhash64(text) AS tie").collect()
    order = sorted(rows, key=lambda r: (r.key is None, -(r.key or 0), r.tie))
    expected = {r.text: after.text for r, after in zip(order, [*order[1:], order[0]])}
    base = df.selectExpr("doc_id AS key", "text", "xxhash64(text) AS tie")
    from pyspark.sql import functions as F

    got = sketch.followed(base, "key", "tie", F.col("text"), "next").collect()
    assert {r.text: r.next for r in got} == expected and len(got) == len(keys)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [
        (0, [1.0, 0.5]), (20, [1.0, 0.5]), (20, [1.0, 0.5]), (3, [2.0, -1.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]),
        (7, [None, 1.0]), (8, []), (9, [3.0]), (None, [1.0, 1.0]), (40, [1e9, 1e9]), (10, [0.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, 1) for r in data], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(df, "vec_id", "embedding", every=20, k=3, shard_rows=3, block_queries=2).collect()
    rows = [(k, [int(64 * v // 1) for v in x]) for k, x in data if k not in (None, 4, 5, 6, 7)]
    expected = []
    for i, (q, x) in enumerate(rows):
        if q % 20 == 0:
            scored = [(-sum(a * b for a, b in zip(x, y)), k) for j, (k, y) in enumerate(rows) if j != i]
            expected += [(q, n + 1, k, -s) for n, (s, k) in enumerate(sorted(scored)[:3])]
    assert sorted(tuple(r) for r in got) == sorted(expected)
    assert topk.top_k(df.limit(0), "vec_id", "embedding", every=20).collect() == []


def test_containment_by_length(spark):
    """A passage inside a long text, and half of a text of any length."""
    words = [f"w{i}" for i in range(4000)]
    data = [(f"{n}@{a}", " ".join(words), " ".join(words[a : a + n]), 1.0) for n in (5, 14, 34, 54) for a in range(0, 3900, 150)]
    data += [
        (f"half {n}@{a}", " ".join(words[a : a + n] + words[3000:]), " ".join(words[a : a + 2 * n]), (n - 4) / (2 * n - 4))
        for n in (10, 30, 75) for a in range(0, 2000, 100)
    ]
    df = spark.createDataFrame(data, "id string, a string, b string, share double")
    for name in "ab":
        df = sketch.sketched(df, name, f"s{name}")
    rows = df.select("id", "share", sketch.containment(df.sb, df.sa).alias("found")).collect()
    off, unknown = {}, {}
    for r in rows:
        kind = r.id.split("@")[0]
        unknown.setdefault(kind, []).append(r.found is None)
        if r.found is not None:
            off.setdefault(kind, []).append(abs(r.found - r.share))
    assert all(v == 0 for n in ("5", "14", "34", "54") for v in off[n])  # what is inside is found inside
    assert sum(unknown["5"]) < 20 and not any(any(unknown[n]) for n in unknown if n not in ("5", "14"))
    for kind, most in (("half 10", 0.2), ("half 30", 0.09), ("half 75", 0.06)):
        assert sum(off[kind]) / len(off[kind]) < most, kind


def test_ids_at_the_ends_of_the_range(spark):
    ids = [2**63 - 1, -(2**63), 0, 5]
    df = spark.createDataFrame([(i, f"text of {i} with some more words") for i in ids], "doc_id long, text string")
    rows = {r.doc_id: r for r in sketch.edited_sketches(df, "doc_id", "text").collect()}
    order = sorted(ids, reverse=True)
    for key, after in zip(order, [*order[1:], order[0]]):
        own, half = rows[key].text, len(rows[key].text) // 2
        assert rows[key].edited == own[: len(own) - half] + rows[after].text[:half]
    one = sketch.edited_sketches(df.where("doc_id = 0"), "doc_id", "text").first()
    assert one.edited == one.text[: len(one.text) - len(one.text) // 2] + one.text[: len(one.text) // 2]


def test_smallest_hash_takes_no_part_in_containment(spark):
    words = [f"w{i}" for i in range(4000)]
    data = [(i, " ".join(words), " ".join(words[i : i + 8])) for i in range(0, 3900, 100)]
    df = spark.createDataFrame(data, "id int, a string, b string")
    for name in "ab":
        df = sketch.sketched(df, name, f"s{name}", scale=16)
    found = [r.found for r in df.select(sketch.containment(df.sb, df.sa, 16).alias("found")).collect()]
    assert set(found) <= {None, 1.0} and None in found
