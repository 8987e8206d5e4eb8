"""What only the models of op4 and op5 find, in texts they did not learn from: precision and recall per kind."""

import random
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeline.llm import pii, queries, secrets

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def halves(spark):
    """Rows to learn from, and the different texts of the other half."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL")
    learnt = docs.where("doc_id % 2 = 1")
    other = docs.where("doc_id % 2 = 0").select("text").distinct().join(learnt.select("text"), "text", "left_anti")
    return learnt, sorted(r.text for r in other.collect())


def rates(found, wanted):
    """(precision, recall, number wanted) of sets of (text number, start, end)."""
    right = len(found & wanted)
    return right / max(1, len(found)), right / max(1, len(wanted)), len(wanted)


def test_tagger_alone_on_rewritten_spans(halves):
    """Phones without their plus and grouped cards, which base patterns do not see or see otherwise.

    The tagger learns the form of a card; as in ``scan``, what fails its kind's check digit or limits is
    not reported.
    """
    learnt, texts = halves
    model, rng = pii.learn(learnt, "text", queries.PII_SAMPLE), np.random.default_rng(11)
    texts = [t for t in texts if pii.base_spans(t)]
    written = [pii.varied(t, pii.base_spans(t), rng) for t in texts]
    found = model.tag([t for t, _ in written])
    unseen = 0
    for kind in pii.KINDS:
        wanted = {(i, a, b) for i, (_, spans) in enumerate(written) for k, a, b in spans if k == kind}
        got = {(i, a, b) for i, spans in enumerate(found) for k, a, b in spans if k == kind}
        got = {(i, a, b) for i, a, b in got if pii.plausible(kind, written[i][0][a:b])}
        precision, recall, n = rates(got, wanted)
        print(kind, round(precision, 3), round(recall, 3), n)
        least = 0.85 if kind == "email" else 0.9  # the base pattern takes every form of an address
        assert n >= 20 and precision >= least and recall >= least, kind
        base = {(i, a, b) for i, (t, _) in enumerate(written) for k, a, b in pii.base_spans(t) if k == kind}
        unseen += len(wanted & got - base)
    print("only by the model", unseen)
    assert unseen >= 10


@pytest.mark.parametrize("letters,length", [
    (string.ascii_letters + string.digits, 32),
    (string.ascii_letters + string.digits + "+/", 40),
    (string.digits + "ABCDEF", 40),
])
def test_bare_tokens_in_unseen_texts(halves, letters, length):
    """A bare token in every text, at any blank: no base pattern takes it."""
    learnt, texts = halves
    model, rng = secrets.Ratio(*secrets.samples(learnt, "text", queries.SECRET_SAMPLE)), random.Random(7)
    planted, wanted = [], set()
    for i, t in enumerate(texts):
        blanks = [p for p, c in enumerate(t) if c == " "] or [len(t)]
        token, at = "".join(rng.choices(letters, k=length)), rng.choice(blanks)
        planted.append(f"{t[:at]} {token}{t[at:]}")
        wanted.add((i, at + 1, at + 1 + length))
    taken = {(i, a, b) for i, t in enumerate(planted) for _, a, b in secrets.base_spans(t)}
    got = {(i, a, b) for i, spans in enumerate(secrets.scan(planted, model)) for k, a, b in spans if k == "random"}
    precision, recall, n = rates(got, wanted - taken)
    print(length, round(precision, 3), round(recall, 3), n)
    assert n > 500 and precision >= 0.9 and recall >= 0.9
