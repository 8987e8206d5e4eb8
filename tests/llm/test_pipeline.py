"""The pipeline's stages, each on what the one before it kept, against plain versions."""

import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from gradeline.llm import language, pii, queries
from gradeline.session import pin
from tests.llm.test_brute import simhash_of, union

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        made = pin(stage(spark, docs, SF), name)
        out.append((docs, made))
        docs = made
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_in_order():
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["language", "lines", "near_duplicates", "personal_data", "packing"]


def test_columns_and_counts(stages):
    for docs, made in stages[:-1]:
        assert made.columns == docs.columns and made.dtypes == docs.dtypes
        assert made.where("n_chars <> length(text)").count() == docs.where("n_chars <> length(text)").count()


def test_language_stage(stages):
    docs, made = stages[0]
    model = language.learn(docs, "text", "lang", queries.LANGUAGE_SAMPLE)
    kept = {k for k, t in texts(docs).items() if not model.predict(t, 0.1)[2]}
    assert set(texts(made)) == kept and len(kept) > 0.97 * docs.count()


def test_line_stage(stages):
    docs, made = stages[1]
    sites = defaultdict(set)
    for r in docs.collect():
        for line in r.text.split("\n"):
            sites[line.strip(" ")].add(r.source)
    many = {line for line, found in sites.items() if line and len(found) >= queries.LEAST_SITES}
    assert many
    before = texts(docs)
    times = Counter(before.values())
    for key, text in texts(made).items():
        old = before[key]
        new = "\n".join(x for x in old.split("\n") if x.strip(" ") not in many)
        own = [x for x in old.split("\n") if x.strip(" ") and x.strip(" ") not in many]
        assert text == (new if own or times[old] == 1 else old)


def test_near_stage(stages):
    """One of each group of texts within 4 bits stays, that with the smallest number, and as it was."""
    docs, made = stages[2]
    before, after = texts(docs), texts(made)
    prints = {k: simhash_of(t) for k, t in before.items()}
    keys = sorted(before)
    close = [(a, b) for a in keys for b in keys if a < b and (prints[a] ^ prints[b]).bit_count() <= 4]
    groups = union(keys, close)
    assert len(set(groups.values())) < len(keys)
    assert after == {k: before[k] for k in set(groups.values())}


def test_personal_stage(stages):
    docs, made = stages[3]
    model = pii.learn(docs, "text", queries.PII_SAMPLE)
    before, after = texts(docs), texts(made)
    assert before.keys() == after.keys()
    found = dict(zip(before, pii.scan(list(before.values()), model)))
    for key, text in after.items():
        assert text == pii.masked(before[key], found[key])
        assert pii.base_spans(text) == []


def test_packing_stage(stages):
    docs, made = stages[4]
    pieces = made.collect()
    assert Counter(r.doc_id for r in pieces).keys() == texts(docs).keys()
    length, whole = Counter(), {}
    for r in pieces:
        length[r.doc_id] += r.length
        whole[r.doc_id] = r.doc_tokens
    assert length == whole


def test_run_gives_the_last_stage(spark, stages):
    assert sorted(map(tuple, pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[-1][1].collect()))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = pin(stage(spark, docs, SF))
        assert docs.count() == 0


@pytest.mark.parametrize("bits", range(3, 8))
def test_near_stage_links_up_to_four_bits(spark, bits):
    """Texts whose fingerprints differ in so many bits: up to four one stays, beyond both."""
    rng = random.Random(bits)
    pairs = []
    while len(pairs) < 12:
        words = [f"w{rng.random()}" for _ in range(60)]
        other = list(words)
        other[rng.randrange(60)] = "x"
        a, b = " ".join(words), " ".join(other)
        if (simhash_of(a) ^ simhash_of(b)).bit_count() == bits:
            pairs += [a, b]
    data = [(i, t, len(t)) for i, t in enumerate(pairs)]
    docs = spark.createDataFrame(data, "doc_id long, text string, n_chars long")
    kept = sorted(r.doc_id for r in pipeline.near_stage(spark, docs, SF).collect())
    assert kept == ([i for i, _, _ in data if i % 2 == 0] if bits <= 4 else [i for i, _, _ in data])
