import ipaddress
import json
import random

from pyspark.sql import functions as F

from gradeline import blocklists
from gradeline.functions.events import format_event
from gradeline.functions.urls import blocked_group, group_text, is_chat_call, is_loopback, url_host
from gradeline.operators import audit


def apply(spark, values, column):
    rows = spark.createDataFrame(list(enumerate(values)), "i INT, v STRING")
    return [r.x for r in rows.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_blocklist(spark):
    groups = [["X.com", "foo"], ["foo"]]
    urls = ["HTTPS://X.com/FOO/1", "http://y.com/foo", "http://y.com/"]
    assert apply(spark, urls, lambda u: blocked_group(u, groups)) == [0, 1, None]
    assert apply(spark, urls, lambda u: group_text(blocked_group(u, groups), groups)) == ["X.com foo", "foo", None]
    assert apply(spark, urls, lambda u: blocked_group(u, [])) == [None] * 3
    assert apply(spark, urls, lambda u: blocked_group(u, [["zzz"], []])) == [1] * 3


def test_longest_blocklist_compiles(spark):
    urls = ["https://github.com/x/MAVE-and-alvations", "https://example.com/", "https://x/2404.15592"]
    got = apply(spark, urls, lambda u: blocked_group(u, blocklists.EXTRACTION))
    assert blocklists.EXTRACTION[got[0]] == ["github", "alvations", "mave"] and got[1] is None
    assert blocklists.EXTRACTION[got[2]] == ["2404.15592"]


def test_list_of_groups_against_its_branches(spark):
    rng = random.Random(3)

    def word(least, most):
        return "".join(rng.choice("abAB.") for _ in range(rng.randint(least, most)))

    groups = [[word(0, 9) for _ in range(rng.randint(1, 3))] for _ in range(60)] + [["a"], ["zzz", "b"]]
    for chosen in (groups, groups + [[]], []):
        urls = [word(0, 30) for _ in range(300)] * 2 + [None, "", "ä" * 12]
        rows = spark.createDataFrame(list(enumerate(urls)), "i INT, url STRING")
        listed = spark.createDataFrame(list(enumerate(chosen)), "position INT, parts ARRAY<STRING>")
        got = {r.i: r.blocked_by for r in audit.blocked_by_list(rows, listed).collect()}
        assert len(got) == len(urls) and rows.columns + ["blocked_by"] == audit.blocked_by_list(rows, listed).columns
        for i, url in enumerate(urls):
            hits = [] if url is None else [n for n, g in enumerate(chosen) if all(p.lower() in url.lower() for p in g)]
            assert got[i] == min(hits, default=None)


def is_local(host):
    try:
        address = ipaddress.ip_address(host)
        return address.is_loopback or address.is_unspecified
    except ValueError:
        return "localhost" in host.lower()


def test_loopback_like_python(spark):
    hosts = [
        "127.0.0.1", "127.255.255.255", "127.0.0.256", "127.1", "127.00.0.1", "128.0.0.1", "0.0.0.0", "0.0.0.1", "::1", "::",
        "::2", "0:0:0:0:0:0:0:1", "0:0:0:0:0:0:0:0", "0000::0001", "0::0:1", "::0:0", "0:0:1", "1::", "1::1", "localhost",
        "my-LocalHost.lan", "127.0.0.1.nip.io", "example.com", "", "::1:", "0:0:0:0:0:0:0::", "::0:0:0:0:0:0:1", "fe80::1",
    ]
    assert apply(spark, hosts, is_loopback) == [is_local(h) for h in hosts]


def test_hosts(spark):
    urls = ["http://[::1]:80/x", "https://User@Example.com:443/a?b", "not a url", "http://127.0.0.1/"]
    assert apply(spark, urls, url_host) == ["[::1]", "Example.com", None, "127.0.0.1"]
    assert apply(spark, urls, lambda u: is_loopback(url_host(u))) == [True, False, False, True]


def test_chat_call(spark):
    rows = spark.createDataFrame(
        [("openrouter.ai", "POST", "/api/v1/chat/completions?x=1", True), ("openrouter.ai", "GET", "/api/v1/chat/completions", False),
         ("openrouter.ai", "POST", "/api/v1/chat/completions/", False), ("other.ai", "POST", "/api/v1/chat/completions", False),
         (None, "POST", "/", False)],
        "host STRING, method STRING, path STRING, want BOOLEAN",
    )
    got = rows.select(is_chat_call(F.col("host"), F.col("method"), F.col("path")).alias("x"), "want").collect()
    assert all(r.x == r.want for r in got)


CHAT = ("https://openrouter.ai/api/v1/chat/completions", "/api/v1/chat/completions")
VERDICTS = [
    # url, path, key_ok, spent, allowed -> verdict, status
    ("http://bad.com/", "/", False, True, False, "blocked", 403),
    ("http://127.0.0.1/", "/", False, True, False, "loopback", 403),
    (*CHAT, False, True, False, "bad key", 403),
    (*CHAT, True, True, False, "budget spent", 402),
    (*CHAT, True, False, False, "model not allowed", 403),
    (*CHAT, True, False, True, "forward", None),
    ("http://fine.com/", "/", False, True, False, "forward", None),
]


def test_verdict_order(spark):
    rows = spark.createDataFrame(
        [(i, u, p, "POST", k, s, a) for i, (u, p, k, s, a, *_) in enumerate(VERDICTS)],
        "i INT, url STRING, path STRING, method STRING, key_ok BOOLEAN, spent BOOLEAN, allowed BOOLEAN",
    )
    flagged = audit.with_url_flags(rows, [["bad.com"]])

    def run(enforce):
        name, status = audit.verdict(F.col("key_ok"), F.col("spent"), F.col("allowed"), enforce)
        return [(r.v, r.s) for r in flagged.select("i", name.alias("v"), status.alias("s")).orderBy("i").collect()]

    assert run(True) == [v[-2:] for v in VERDICTS]
    assert run(False)[3] == ("model not allowed", 403)


EVENTS = [
    ({"type": "step_start", "sessionID": "s1"}, "[opencode/step_start] session=s1"),
    ({"type": "step_finish"}, "[opencode/step_finish] session=unknown"),
    ({"type": "text", "part": {"type": "text", "text": "a\nb"}}, "[opencode/text] a b"),
    ({"type": "text", "part": {"type": "text", "text": ""}}, "[opencode/text]"),
    ({"part": {"type": "reasoning", "text": "why"}}, "[opencode/reasoning] why"),
    ({"type": "tool_use", "part": {"type": "tool", "tool": "bash", "state": {"status": "s", "input": {"command": "ls"}}}}, "[opencode/tool_use] bash command=ls"),
    ({"type": "tool_use", "part": {"type": "tool", "tool": "bash", "state": {"status": "s", "input": {"command": ""}}}}, "[opencode/tool_use] bash status=s"),
    ({"type": "tool_use", "part": {"type": "tool", "tool": "edit", "state": {"input": {"command": "x"}}}}, "[opencode/tool_use] edit status=unknown"),
    ({"type": "tool_use", "part": {"type": "tool"}}, "[opencode/tool_use] unknown status=unknown"),
    ({"type": "other", "x": 1}, '[opencode/other] {"type": "other", "x": 1}'),
    ({"x": 1}, '[opencode/unknown] {"x": 1}'),
]


def test_event_lines(spark):
    lines = [json.dumps(e) for e, _ in EVENTS] + ["plain line", "{broken", ""]
    assert apply(spark, lines, format_event) == [t for _, t in EVENTS] + ["plain line", "{broken", ""]


def test_latest_session(spark):
    rows = spark.createDataFrame([("a", 1, "s1"), ("a", 3, None), ("a", 2, "s2"), ("b", 1, None)], "run STRING, seq INT, session_id STRING")
    assert [tuple(r) for r in audit.latest_session(rows).collect()] == [("a", "s2")]
