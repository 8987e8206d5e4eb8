"""Periodic runs, compression bands and centroid clustering against plain versions, and their edges."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from gradeline.llm import bisector, compression, queries, runs
from tests.llm.test_edges import DATA, ROWS, SCHEMA
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def plain_runs(words, least=6, exponent=4):
    out, n = [], len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            smaller = any(all(words[i + t] == words[i + t + p] for t in range(size - p)) for p in range(1, q))
            if j > i and size >= max(least, exponent * q) and not smaller:
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_all_found(seed):
    rng = random.Random(seed)
    for _ in range(500):
        words = [rng.randrange(rng.randint(1, 4)) for _ in range(rng.randint(0, 60))]
        if words:
            base = [rng.randrange(4) for _ in range(rng.randint(1, 6))]
            at, size = rng.randrange(len(words)), rng.randint(4, 40)
            words[at : at + size] = (base * 40)[:size]
        assert runs.word_runs(words) == plain_runs(words)
        assert runs.word_runs(words, 2, 2) == plain_runs(words, 2, 2)


def test_common_prefixes():
    rng = random.Random(3)
    for _ in range(60):
        words = np.array([rng.randint(1, 3) for _ in range(rng.randint(2, 150))])
        tree, n = runs.Tree(words), len(words)
        pairs = np.array([rng.sample(range(n + 1), 2) for _ in range(100)])
        for (a, b), size in zip(pairs.tolist(), tree.common(pairs[:, 0], pairs[:, 1]).tolist()):
            plain = 0
            while max(a, b) + plain < n and words[a + plain] == words[b + plain]:
                plain += 1
            assert size == plain
        suffixes = [words[i:].tolist() for i in range(n + 1)]
        assert tree.ranks(False).tolist() == np.argsort(np.argsort(sorted_places(suffixes))).tolist()
        falling = [[-w for w in s] for s in suffixes]
        assert tree.ranks(True).tolist() == np.argsort(np.argsort(sorted_places(falling))).tolist()


def sorted_places(suffixes):
    order = sorted(range(len(suffixes)), key=lambda i: suffixes[i])
    return np.argsort(order)


def edited(key, words):
    h, n = zlib.crc32(str(key).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def test_run_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    assert found.keys() == texts.keys() and any(r.n_runs for r in found.values())
    for key, text in texts.items():
        words, row = edited(key, [w.decode() for w in text.encode().split()]), found[key]
        if len(words) < 300:
            plain = plain_runs(words)
            assert row.n_runs == len(plain)
            assert row.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in plain).encode()).hexdigest()
            drop = {i for s, n, p in plain for i in range(s + p, s + n)}
            kept = " ".join(w for i, w in enumerate(words) if i not in drop)
            assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
            best = min(plain, key=lambda r: (-r[1], r[0], r[2]), default=None)
            values = (row.start, row.length, row.period, row.exponent_milli)
            assert values == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)


def plain_quality(text):
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w in windows if windows.count(w) > 1}
    held = {i + d for i, w in enumerate(windows) if w in often for d in range(3)}
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text),
        sum(line in lines[:i] for i, line in enumerate(lines)), len(held),
    )


def test_quality_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = queries.op12_quality_rules(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        if len(texts[r.doc_id]) < 4000:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.ratio == pytest.approx(plain_bands(texts[r.doc_id])[0])
        assert r.kept == (not r.base_failed and plain_bands(texts[r.doc_id])[1])


def plain_bands(text):
    import zstandard

    press = zstandard.ZstdCompressor(level=3, write_checksum=False, write_content_size=False)

    def inside(part):
        limits = [x for x in compression.Bands().limits if len(part) >= x[0]]
        return not limits or limits[-1][1] <= len(press.compress(part)) / len(part) <= limits[-1][2]

    raw = text.encode()
    odd = sum(len(raw[a : a + 2048]) for a in range(0, len(raw), 2048) if not inside(raw[a : a + 2048]))
    return len(press.compress(raw)) / len(raw), inside(raw) and odd <= 0.3 * len(raw)


def test_bands_see_what_counts_do_not(spark):
    rng = random.Random(1)
    parts = "an ber con de el for ing ka lo men nor os per qui ra ste tur un ver wo".split()
    prose = " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(900))
    noise = " ".join(base64.b85encode(rng.randbytes(40)).decode() for _ in range(120))
    numbered = " ".join(f"Item {i} of the very same list, to be continued on another page below;" for i in range(300))
    half = prose[:3000] + " " + base64.b85encode(rng.randbytes(9000)).decode()
    data = [("prose", prose), ("noise", noise), ("numbered", numbered), ("half", half), ("short", "a b"), ("empty", ""), ("null", None)]
    found = {r.name: r for r in compression.judge_texts(spark.createDataFrame(data, "name string, text string"), "name", "text").collect()}
    assert {k for k, r in found.items() if not r.in_bands} == {"noise", "numbered", "half"}
    assert found["null"].ratio is None and found["empty"].n_words == 0


def plain_clusters(rows, k=8, rounds=10):
    keyed = sorted((hashlib.sha256(f"3:{key}".encode()).hexdigest(), v, key) for key, v in rows)
    centroids = [v for _, v, _ in keyed[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        held = [[] for _ in centroids]
        for _, v in rows:
            held[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(part) for x in zip(*part)] if part else c for part, c in zip(held, centroids)]
    return [(key, nearest(v)[1], nearest(v)[0]) for key, v in rows], centroids


def test_cluster_query(spark):
    assert compare(spark, connect(SF), SF, *queries.QUERIES["op13_centroid_clusters"]) is None


def test_clusters(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randint(-3, 3) / 4 for _ in range(4)]) for i in range(150)]
    rows += [(i, list(v)) for i, v in rows[:20]] + [(1000 + i, rows[0][1]) for i in range(30)]
    bad = [(7001, None), (7002, [1.0] * 3), (7003, [1.0, None, 1.0, 1.0]), (7004, [1.0, float("nan"), 1.0, 1.0]), (7005, [1.0, float("-inf"), 1.0, 1.0])]
    data = spark.createDataFrame([(k, v, 1, 2, 3) for k, v in rows + bad], "id long, v array<float>, cluster int, key int, distance int")
    found = bisector.cluster(data, "id", "v", size=4, scale=8).collect()
    plain, centroids = plain_clusters([(k, [int(np.floor(8 * x)) for x in v]) for k, v in rows])
    assert sorted((r.id, r.cluster, r.distance) for r in found) == sorted(plain)
    assert all(list(r.centroid) == centroids[r.cluster] for r in found)
    assert {r.inertia for r in found} == {sum(d for _, _, d in plain)}
    assert {(r.cluster, r.cluster_inertia) for r in found} == {(c, sum(d for _, x, d in plain if x == c)) for _, c, _ in plain}
    few = bisector.cluster(data.where("id in (1, 2, 7003)"), "id", "v", size=4, scale=8).collect()
    assert len({r.id for r in few}) == 2
    assert bisector.cluster(data.where("id > 7000"), "id", "v", size=4).collect() == []


def test_ties_go_to_the_smaller_number():
    planes = bisector.Tournament(np.array([[4, 0], [0, 0], [4, 0], [0, 4]]))
    winner, apart = planes.nearest(np.array([[2, 0], [4, 0], [2, 2], [0, 2], [-9, -9]]))
    assert winner.tolist() == [0, 0, 0, 1, 1] and apart.tolist() == [4, 0, 8, 4, 162]


def test_large_components_raise():
    with pytest.raises(ValueError, match="64 bits"):
        bisector.integers(np.full((1, 64), 1e9), 1024)


def test_edge_rows(spark):
    docs, empty = spark.createDataFrame(ROWS, SCHEMA), spark.createDataFrame([], SCHEMA)
    for run in (
        lambda d: runs.periodic_runs(d, "doc_id", "text", edit=runs.repeat_tail), lambda d: compression.judge_texts(d, "doc_id", "text"),
    ):
        rows = run(docs).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in DATA)
        assert run(empty).collect() == []
    long = {r.doc_id: r for r in runs.periodic_runs(docs, "doc_id", "text").collect()}
    assert [tuple(r) for r in long[5].runs] == [(0, 30000, 6)] and long[5].collapsed.count(" ") == 5
    assert long[3].runs == [] and long[3].collapsed == "" == long[4].collapsed
