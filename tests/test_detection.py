import random

import pytest

from gradeline.operators import detection as det, prefix

SCHEMA = "idx BIGINT, id STRING, model STRING, domain STRING, attack STRING, decoding STRING, repetition_penalty STRING"


@pytest.fixture(params=["one block", "many blocks"], autouse=True)
def path(request, monkeypatch):
    if request.param == "many blocks":
        monkeypatch.setattr(prefix, "BLOCK_ROWS", 3)


def rows_of(spark, rows, partitions=4):
    gold = [(i, f"d{i}", m, d, a, "greedy", "no") for i, (m, d, a, _) in enumerate(rows)]
    preds = [(i, repr(s)) for i, (*_, s) in enumerate(rows)]
    return (
        spark.createDataFrame(gold, SCHEMA).repartition(partitions),
        spark.createDataFrame(preds, "idx BIGINT, pred STRING").repartition(partitions + 1),
    )


def prepared(spark, rows):
    hist = det.histogram(det.score_rows(*rows_of(spark, rows)))
    return hist, det.human_ranks(hist)


def brute_auroc(machine, human):
    if not machine or not human:
        return None
    wins = sum((m > h) + 0.5 * (m == h) for m in machine for h in human)
    return wins / (len(machine) * len(human))


def test_auroc_fixture(spark):
    rows = [("g", "x", "none", s) for s in (0.9, 0.4)] + [("human", "x", "none", s) for s in (0.4, 0.1)]
    row = det.auroc(prepared(spark, rows)[1]).first()
    assert (row.auroc, row.n_human, row.n_machine, row.distinct_preds) == (0.875, 2, 2, 3)


def test_auroc_one_class_is_null(spark):
    assert det.auroc(prepared(spark, [("g", "x", "none", 0.5)])[1]).first().auroc is None


def test_threshold_fixture(spark):
    rows = [("human", "x", "none", s) for s in (0.1, 0.2, 0.2, 0.9)] + [("g", "x", "none", s) for s in (0.3, 0.9, 0.95, 0.2)]
    _, ranks = prepared(spark, rows)
    limits = det.thresholds(ranks, det.scope_totals(ranks), [0.25, 0.0]).where("scope = 'all'").first()
    assert (limits["threshold_fpr_0_25"], limits["achieved_fpr_0_25"]) == (0.3, 0.25)
    assert (limits["threshold_fpr_0"], limits["achieved_fpr_0"]) == (0.95, 0.0)


def random_rows(seed, n=240):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        model = rng.choice(["human", "g1", "g2"])
        hot = rng.random() < 0.35  # one score holds a third of the rows
        score = 0.5 if hot else round(rng.random(), rng.choice([1, 4]))
        out.append((model, rng.choice(["news", "books"]), rng.choice(["none", "typo"]), score))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_grid_brute_force(spark, seed):
    rows = random_rows(seed)
    hist, ranks = prepared(spark, rows)
    grid = {tuple(r[a] for a in det.AXES): r for r in det.score_grid(hist, ranks).collect()}
    human = [s for m, _, _, s in rows if m == "human"]
    seen = sorted({s for *_, s in rows})
    limit = min((t for t in seen if sum(h >= t for h in human) / len(human) <= 0.05), default=float("inf"))
    cells = [("all", "all", "all"), ("news", "all", "all"), ("all", "g1", "none"), ("books", "g2", "typo")]
    for domain, model, attack in cells:
        machine = [
            s for m, d, a, s in rows
            if m != "human" and domain in ("all", d) and model in ("all", m) and attack in ("all", a)
        ]
        others = [s for m, d, _, s in rows if m == "human" and domain in ("all", d)]
        cell = grid[(domain, model, "all", "all", attack)]
        assert cell.n_machine == len(machine)
        assert cell.auroc == pytest.approx(brute_auroc(machine, others))
        assert cell.accuracy_fpr_0_05 == pytest.approx(sum(s >= limit for s in machine) / len(machine))


def test_headline_notes_absent_cell(spark):
    rows = [("g", "x", "typo", 0.9), ("human", "x", "typo", 0.1)]
    out = {r.headline: r for r in det.headline(det.score_grid(*prepared(spark, rows))).collect()}
    assert out["all"].note is None and out["all"].auroc == 1.0
    assert out["no_adversarial"].auroc is None and out["no_adversarial"].note


def test_reserved_slice_name_is_refused(spark):
    with pytest.raises(Exception, match="reserved"):
        prepared(spark, [("g", "all", "none", 0.9), ("human", "x", "none", 0.1)])


def test_missing_predictions_are_chance_and_extra_raise(spark):
    gold, preds = rows_of(spark, [("g", "x", "none", 0.9), ("human", "x", "none", 0.1), ("human", "x", "none", 0.2)])
    scores = {r.idx: r.score for r in det.score_rows(gold, preds.where("idx < 2")).collect()}
    assert scores == {0: 0.9, 1: 0.1, 2: 0.5}
    with pytest.raises(Exception, match="without a gold row"):
        det.score_rows(gold.where("idx < 2"), preds).collect()


def test_report_auroc_only(spark):
    gold, preds = rows_of(spark, random_rows(9, 40))
    whole = det.score_detection(gold, preds).first()
    quick = det.score_detection(gold, preds, auroc_only=True).first()
    assert quick.score_agg["all"].auroc == pytest.approx(whole.score_agg["all"].auroc)
    assert quick.auroc_only and whole.per_domain_tuning is False


def test_missing_slice_keys_are_kept(spark):
    rows = [("g", None, "none", 0.9), ("g", "x", "none", 0.8), ("human", None, "none", 0.1)]
    grid = det.score_grid(*prepared(spark, rows)).collect()
    assert [r.n_machine for r in grid if all(r[a] == "all" for a in det.AXES)] == [2]
    assert [r.auroc for r in grid if r.domain == "" and r.model == "all" and r.attack == "all" and r.decoding == "all" and r.repetition_penalty == "all"] == [1.0]
