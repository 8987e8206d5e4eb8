"""Input schemas, as Spark DDL."""

RELEVANCE_RAW = (
    "example_id BIGINT, query_id BIGINT, product_id STRING, query STRING, product_title STRING, "
    "product_brand STRING, product_color STRING, product_description STRING, "
    "product_bullet_point STRING, product_locale STRING, esci_label STRING, large_version INT"
)

EXTRACTION_FULL = (
    "id STRING, category STRING, paragraphs ARRAY<STRUCT<text: STRING, source: STRING>>, "
    "attributes ARRAY<STRUCT<key: STRING, evidences: ARRAY<STRUCT<value: STRING, pid: BIGINT, "
    "`begin`: BIGINT, `end`: BIGINT>>>>"
)

DETECTION_GOLD = ("id", "model", "domain", "attack", "decoding", "repetition_penalty", "source_id")

USAGE = (
    "STRUCT<prompt_tokens: BIGINT, completion_tokens: BIGINT, "
    "prompt_tokens_details: STRUCT<cached_tokens: BIGINT, cache_write_tokens: BIGINT>>"
)

RESPONSE = (
    "STRUCT<choices: ARRAY<STRUCT<message: STRUCT<role: STRING, content: STRING>, "
    f"finish_reason: STRING>>, usage: {USAGE}, "
    "error: STRUCT<message: STRING, metadata: MAP<STRING, STRING>>>"
)

REQUEST = (
    "STRUCT<messages: ARRAY<STRUCT<role: STRING, content: STRING>>, model: STRING, max_tokens: INT, "
    "reasoning_effort: STRING, reasoning: STRUCT<effort: STRING>>"
)

RAW_CALL = (
    f"idx BIGINT, request {REQUEST}, cost STRUCT<mtok: DOUBLE, usd: DOUBLE>, "
    f"walltime_min DOUBLE, response {RESPONSE}"
)

BATCH_REQUEST = f"custom_id STRING, body {REQUEST}"

BATCH_RESULTS = (
    "id STRING, status STRING, results ARRAY<STRUCT<custom_id: STRING, response: STRING>>"
)

# As files are read: a string field takes the bytes of whatever value stands there.
RAW_CALL_FILE = f"idx BIGINT, request {REQUEST}, cost STRUCT<mtok: DOUBLE, usd: DOUBLE>, walltime_min DOUBLE, response STRING"

BATCH_RESULTS_FILE = (
    "id STRING, status STRING, "
    "results ARRAY<STRUCT<custom_id: STRING, response: STRUCT<status_code: INT, body: STRING>>>"
)

BATCH_RESULT = f"STRUCT<status_code: INT, body: {RESPONSE}>"

CALL_HISTORY = (
    "time DOUBLE, run STRING, seq BIGINT, model STRING, path STRING, status_code INT, "
    "request STRING, response STRING"
)

REQUEST_LOG = "url STRING, status_code INT"

AGENT_EVENT = (
    "type STRING, sessionID STRING, part STRUCT<type: STRING, text: STRING, tool: STRING, "
    "state: STRUCT<status: STRING, input: STRING>>"
)

PRICES = (
    "model STRING, tag STRING, base_input_per_mtok DOUBLE, output_per_mtok DOUBLE, "
    "cache_hit_refresh_per_mtok DOUBLE, `5m_cache_write_per_mtok` DOUBLE, `1h_cache_write_per_mtok` DOUBLE"
)

WEIGHTS = "counter STRING, weight DOUBLE, description STRING"

ROUTES = "model STRING, slug STRING, provider STRING"

SWEEP = "seq BIGINT, learning_rate DOUBLE, eval_loss DOUBLE, student_dir STRING, walltime_min DOUBLE"
