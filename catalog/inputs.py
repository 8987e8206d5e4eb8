"""Labelling workloads stated over the test tables, in SQL that both engines read alike.

Replies, usage and requests are made from the tables by formula, so scores here prove arithmetic,
not model quality. Backslashes and line breaks are spelled chr(92) and chr(10).
"""

# Orders as query-product pairs: the priority is the judged label, early orders got no reply.
RELEVANCE_GOLD = """
SELECT o_orderkey AS idx, CAST(o_orderkey AS STRING) AS example_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Exact' WHEN '2-HIGH' THEN 'Substitute'
    WHEN '3-MEDIUM' THEN 'Complement' ELSE 'Irrelevant' END AS label
FROM $orders"""

RELEVANCE_REPLIES = """
SELECT o_orderkey AS idx,
  CASE WHEN o_totalprice > 400000 THEN 'Exact match'
    WHEN o_totalprice > 250000 THEN concat(' ', CASE o_orderpriority WHEN '1-URGENT' THEN 'e'
      WHEN '2-HIGH' THEN 's' WHEN '3-MEDIUM' THEN 'C' ELSE 'I' END, chr(10))
    WHEN o_orderstatus = 'F' THEN 'E' WHEN o_orderstatus = 'O' THEN 's' ELSE ' C ' END AS pred
FROM $orders"""

RELEVANCE_PREDS = f"{RELEVANCE_REPLIES} WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'"

# Parts as products: gold values are words of the name, some parts state none.
EXTRACTION = """
SELECT p_partkey AS idx,
  CASE WHEN p_size > 8 THEN concat('The ', split_part(p_name, ' ', 1), '!') END AS value_1,
  CASE WHEN p_size > 40 THEN concat(' ', p_type, '.') END AS value_2,
  CASE WHEN p_size < 4 THEN '<NO_VALUE>' WHEN p_brand = 'Brand#4' THEN concat(' <NO_VALUE>', chr(10))
    WHEN p_type = 'ECONOMY' THEN upper(split_part(p_name, ' ', 1))
    WHEN p_type = 'SMALL' THEN concat('a ', lower(p_type))
    WHEN p_size > 30 THEN concat(split_part(p_name, ' ', 1), ', the')
    ELSE split_part(p_name, ' ', 2) END AS pred
FROM $part"""

# Documents as texts to judge: curated ones are human; long ones exceeded the window.
DETECTION_GOLD = """
SELECT d.doc_id AS idx, concat('d', CAST(d.doc_id AS STRING)) AS id,
  CASE WHEN l.quality = 1 THEN 'human' WHEN l.quality = 0 THEN 'gen-a' ELSE 'gen-b' END AS model,
  d.lang AS domain, CASE WHEN l.toxic = 1 THEN 'paraphrase' ELSE 'none' END AS attack,
  CASE WHEN d.source < 'src2' THEN 'greedy' ELSE 'sampling' END AS decoding,
  CASE WHEN d.n_chars > 1500 THEN 'yes' ELSE 'no' END AS repetition_penalty, d.source AS source_id
FROM $documents d LEFT JOIN $labels l ON d.doc_id = l.doc_id"""

DETECTION_REPLIES = """
SELECT doc_id AS idx,
  CASE WHEN n_chars < 200 THEN 'Machine: 0.9'
    WHEN n_chars < 600 THEN concat('  .', lpad(CAST(n_chars AS STRING), 4, '0'), chr(10))
    WHEN n_chars < 700 THEN '1e-1' WHEN n_chars < 800 THEN 'nan' WHEN n_chars < 900 THEN '0_0.2_5'
    WHEN n_chars < 950 THEN '0.9f' WHEN n_chars < 1000 THEN '1.0001' WHEN n_chars < 1050 THEN '-0'
    ELSE concat('0.', lpad(CAST(n_chars % 1000 AS STRING), 3, '0')) END AS pred
FROM $documents"""

DETECTION_PREDS = f"{DETECTION_REPLIES} WHERE n_chars <= 8000"

# Events as model calls: one run per user, one model per event type. The body forms cover plain
# JSON, chunks, missing parts, chunks that lose the usage, empty bodies and failed calls.
_CALL_BASE = """
SELECT event_id, user_id, event_type, ts, value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, CAST(round(value * 100) AS BIGINT) AS c
FROM $events"""

_USAGE = """concat('"usage": {"prompt_tokens": ', CAST(c + 3 * k AS STRING), ', "completion_tokens": ',
  CAST(10 * k + 7 AS STRING), ', "prompt_tokens_details": {"cached_tokens": ', CAST(k AS STRING),
  ', "cache_write_tokens": ', CAST(2 * k AS STRING), '}}')"""

CALLS = f"""
SELECT event_id AS idx, CAST(user_id AS STRING) AS run, event_type AS model, ts, k, c,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code,
  value / 600 AS walltime_min,
  CASE WHEN event_type = 'click' OR (event_type = 'purchase' AND k >= 40) THEN
      concat('{{"id": "r', CAST(event_id AS STRING), '", "choices": [{{"message": {{"role": "assistant", "content": "E"}}, "finish_reason": "stop"}}], ', u, '}}')
    WHEN event_type = 'view' THEN concat('data: {{"choices": []}}', chr(10), chr(10),
      'data: {{"choices": [], ', u, '}}', chr(10), chr(10), 'data: [DONE]', chr(10))
    WHEN event_type = 'signup' THEN concat('{{"choices": [], "usage": {{"prompt_tokens": ', CAST(c AS STRING), ', "completion_tokens": 5}}}}')
    WHEN event_type = 'purchase' AND k >= 20 THEN concat('data: {{', u, '}}', chr(10), 'data: {{"choices": []}}', chr(10))
    WHEN event_type = 'purchase' THEN ''
    ELSE '{{"error": {{"message": "overloaded"}}}}' END AS body
FROM (SELECT *, {_USAGE} AS u FROM ({_CALL_BASE}) base) used"""

# Events as batch results: cheap ones never came back.
BATCH_RESULTS = f"""
SELECT event_id AS idx,
  CASE event_type
    WHEN 'click' THEN concat('{{"status_code": 200, "body": {{"choices": [{{"message": {{"role": "assistant", "content": "c', CAST(k AS STRING), ' "}}, "finish_reason": "stop"}}]}}}}')
    WHEN 'view' THEN concat('{{"status_code": 200, "body": {{"choices": [{{"message": {{"role": "assistant", "content": "v"}}, "finish_reason": "', CASE WHEN k < 30 THEN 'length' ELSE 'stop' END, '"}}]}}}}')
    WHEN 'signup' THEN concat('{{"status_code": 403, "request_id": "q", "body": {{"id": "r', CAST(event_id AS STRING), '", "provider": "p1", "error": {{"code": 403, "message": "no", "metadata": {{"', CASE WHEN k < 50 THEN 'flagged_input' ELSE 'provider_name' END, '": "x"}}}}}}}}')
    WHEN 'purchase' THEN CASE WHEN k < 50 THEN '{{"status_code": 200, "body": {{"choices": [{{"message": {{"role": "assistant", "content": null}}, "finish_reason": "content_filter"}}]}}}}'
      ELSE '{{"status_code": 200, "body": {{"choices": []}}}}' END
    ELSE '{{"status_code": 500, "body": {{"error": {{"message": "overloaded"}}}}}}' END AS response
FROM ({_CALL_BASE}) base WHERE value >= 5"""

# Events as requests seen by a proxy.
REQUESTS = f"""
SELECT event_id AS idx, CAST(user_id AS STRING) AS run, event_type AS model, k,
  CASE WHEN k < 8 THEN 'https://blocked.example.com/Data/1' WHEN k < 12 THEN 'http://127.0.0.1:8080/x'
    WHEN k < 15 THEN 'http://[::1]/x' WHEN k < 18 THEN 'http://my-LOCALHOST.lan/' WHEN k < 30 THEN 'https://files.example.org/a?b=c'
    ELSE concat('https://openrouter.ai/api/v1/chat/completions', CASE WHEN k < 60 THEN '?x=1' ELSE '' END) END AS url,
  CASE WHEN k < 30 THEN '/x' ELSE concat('/api/v1/chat/completions', CASE WHEN k < 60 THEN '?x=1' ELSE '' END) END AS path,
  CASE WHEN k > 95 THEN 'GET' ELSE 'POST' END AS method, (c % 100) > 4 AS key_ok
FROM ({_CALL_BASE}) base"""

# Conversations as call records: first system, user and assistant turn of each.
TEACHER_PARTS = """
SELECT conv_id AS idx, min_by(CASE WHEN role = 'system' THEN text END, CASE WHEN role = 'system' THEN turn END) AS system_text,
  min_by(CASE WHEN role = 'user' THEN text END, CASE WHEN role = 'user' THEN turn END) AS user_text,
  min_by(CASE WHEN role = 'assistant' THEN text END, CASE WHEN role = 'assistant' THEN turn END) AS answer
FROM $conversations GROUP BY conv_id"""

_ESCAPED = "replace(replace(replace(text, chr(92), concat(chr(92), chr(92))), '\"', concat(chr(92), '\"')), chr(10), concat(chr(92), 'n'))"

# Conversations as an agent's log: plain lines, text parts, tool parts and steps.
EVENT_LINES = f"""
SELECT conv_id, turn, text,
  CASE WHEN role = 'system' THEN concat('starting ', CAST(conv_id AS STRING))
    WHEN role = 'assistant' THEN concat('{{"type": "text", "sessionID": "s', CAST(conv_id AS STRING), '", "part": {{"type": "text", "text": "', {_ESCAPED}, '"}}}}')
    WHEN turn = 0 THEN concat('{{"type": "step_start", "sessionID": "s', CAST(conv_id AS STRING), '"}}')
    WHEN turn = 2 THEN '{{"type": "tool_use", "part": {{"type": "tool", "tool": "bash", "state": {{"status": "done", "input": {{"command": "ls -l"}}}}}}}}'
    WHEN turn = 4 THEN '{{"type": "tool_use", "part": {{"type": "tool", "tool": "edit", "state": {{"status": "done", "input": {{"command": "x"}}}}}}}}'
    ELSE '{{"type": "usage"}}' END AS line
FROM $conversations"""
