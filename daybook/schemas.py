"""Column layouts of the diary tables. owner_id leads every key; days are local dates as yyyy-MM-dd text."""

DIGEST = "summary STRING, events ARRAY<STRING>, agreements ARRAY<STRING>, tasks ARRAY<STRING>, ideas ARRAY<STRING>, mood STRING"
VECTOR = "STRUCT<scale: FLOAT, q: ARRAY<TINYINT>>"
FRAMES = "owner_id STRING, frame_no BIGINT, frame_start_ms BIGINT, prob DOUBLE, dbfs DOUBLE, screen_on BOOLEAN, silenced BOOLEAN, n_samples INT"
TRANSCRIPTS = "owner_id STRING, id BIGINT, start_ms BIGINT, end_ms BIGINT, day STRING, text STRING, model STRING, lang STRING, created_ms BIGINT"
SUMMARIES = "owner_id STRING, day STRING, period_start_ms BIGINT, kind STRING, json STRING, model STRING, source_count BIGINT, source_max_created_ms BIGINT, created_ms BIGINT, gen_ms BIGINT"
CHUNKS = f"owner_id STRING, id BIGINT, day STRING, kind STRING, start_ms BIGINT, end_ms BIGINT, text STRING, hash STRING, vector {VECTOR}, model STRING"
INDEX_DAYS = "owner_id STRING, day STRING, signature STRING, indexed_ms BIGINT, chunks BIGINT"
LOGS = "seq BIGINT, time_ms BIGINT, level STRING, tag STRING, message STRING"

TRANSCRIPT, HOUR, DAY = "TRANSCRIPT", "HOUR", "DAY"
HOUR_MS = 3_600_000
