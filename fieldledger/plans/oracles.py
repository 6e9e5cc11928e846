"""The same queries as SQL over the test tables, for a second engine to check."""

from __future__ import annotations

from fieldledger.plans.queries import (
    AS_OF,
    CURSOR_SEQ,
    FILTER,
    FORM_ID,
    LEDGER_TEMPLATE,
    TEMPLATE,
    _cursor,
)
from fieldledger.sources.sample_views import TEMPLATE_CHANGE_VALUE


def _uuid(namespace: str, seq: str) -> str:
    h = f"sha256('{namespace}:' || CAST({seq} AS VARCHAR))"
    return (
        f"concat_ws('-', substr({h}, 1, 8), substr({h}, 9, 4), '8' || substr({h}, 14, 3), "
        f"'a' || substr({h}, 18, 3), substr({h}, 21, 12))"
    )


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


_K = "CAST(props->>'$.k' AS BIGINT)"
_ACTION = "CASE event_type WHEN 'signup' THEN 'Add' WHEN 'error' THEN 'Delete' ELSE 'Edit' END"
_CHANGE = f"(event_type = 'purchase' AND value >= {TEMPLATE_CHANGE_VALUE})"
_CHANGE_ACTION = f"CASE WHEN {_K} < 50 THEN 'Add' WHEN {_K} < 75 THEN 'Edit' ELSE 'Delete' END"
_MIXED = "'t' || CAST(user_id % 3 AS VARCHAR)"

_FORMS = f"""forms AS (
  SELECT event_id, event_type AS template, CAST(event_id AS VARCHAR) AS id,
    'scouter_' || CAST(user_id % 20 AS VARCHAR) AS scouter, user_id AS team,
    event_id % 80 + 1 AS match_number, strftime(ts, '%Y%m%d') AS event_key,
    CASE WHEN event_id % 19 <> 0 THEN CAST(floor(value) AS BIGINT) END AS score_number,
    CASE WHEN event_id % 19 = 0 THEN CAST(floor(value) AS BIGINT) END AS score_rating,
    {_K} AS k_rating, value > 20 AS big,
    CASE WHEN event_id % 17 <> 0 THEN event_type END AS note, props AS detail,
    CASE WHEN event_id % 23 = 0 THEN CAST(1 AS BIGINT) END AS x,
    CAST(4 + (event_id % 17 <> 0)::INT + (event_id % 23 = 0)::INT AS BIGINT) AS n_fields
  FROM events)"""
_FLAT = (
    "template, id, scouter, team, match_number, event_key, score_number, score_rating, "
    "k_rating, big, note, detail, x"
)


def _filter(*wanted: str) -> str:
    columns = {"event": "event_key"}
    tests = [f"template = '{TEMPLATE}'"]
    for name in wanted:
        value = FILTER[name]
        literal = f"'{value}'" if isinstance(value, str) else str(value)
        tests.append(f"{columns.get(name, name)} = {literal}")
    return _with(_FORMS) + f"SELECT {_FLAT}, n_fields FROM forms WHERE {' AND '.join(tests)}"


_TEMPLATE_FIELDS = """template_fields(pos, field, kind, low, high) AS (VALUES
  (CAST(0 AS BIGINT), 'header', 'Title', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)),
  (1, 'score', 'Number', NULL, NULL), (2, 'k', 'Rating', 0, 50), (3, 'big', 'CheckBox', NULL, NULL),
  (4, 'note', 'ShortText', NULL, NULL), (5, 'detail', 'LongText', NULL, NULL))"""
_TEMPLATES = "templates AS (SELECT DISTINCT event_type AS name, CAST(2024 AS BIGINT) AS year FROM events)"

_SCHEDULES = """shifts AS (
  SELECT 'conv_' || CAST(conv_id AS VARCHAR) AS event,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
    role AS scouter, turn % 6 AS station, turn * 10 AS match_start, turn * 10 + 9 AS match_end
  FROM conversations)"""

_BLOB = "unhex(lpad(to_hex(strlen(url)), 16, '0')) || encode(url) || encode(html)"

# Which fault a form document carries, and the reason it is refused for.
_FAULT = """CASE WHEN event_id % 37 = 0 OR event_id % 41 = 0 THEN 'not_json'
    WHEN event_id % 13 = 0 THEN 'bad_team'
    WHEN event_id % 29 = 0 OR event_id % 31 = 0 THEN 'bad_fields'
    WHEN event_id % 43 = 0 THEN 'bad_scouter' END"""

_JSON = """'{"fields":{"score":{"' || CASE WHEN event_id % 19 = 0 THEN 'Rating' ELSE 'Number' END
  || '":' || CAST(floor(value) AS BIGINT) || '},"k":{"Rating":' || k || '},"big":{"CheckBox":'
  || CASE WHEN value > 20 THEN 'true' ELSE 'false' END || '},"detail":{"LongText":"'
  || replace(props, '"', '\\"') || '"}'
  || CASE WHEN event_id % 17 <> 0 THEN ',"note":{"ShortText":"' || event_type || '"}' ELSE '' END
  || CASE WHEN event_id % 23 = 0 THEN ',"x":{"Number":1}' ELSE '' END
  || '},"scouter":"scouter_' || (user_id % 20) || '","team":' || user_id || ',"match_number":'
  || (event_id % 80 + 1) || ',"event_key":"' || strftime(ts, '%Y%m%d') || '","id":"' || event_id
  || '"}'"""


def _decide(name: str, source: str, keys: str, reason: str = "CAST(NULL AS VARCHAR)") -> str:
    """Accept rule over `source`; rows with a `reason` take no part."""
    return f"""{name}_asked AS (SELECT *, {reason} AS early FROM {source}),
{name}_before AS (
  SELECT *, coalesce(last_value(CASE WHEN early IS NULL AND action <> 'Edit' THEN action END IGNORE NULLS)
    OVER (PARTITION BY {keys} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 'Add',
    false) AS live_before
  FROM {name}_asked),
{name}_decided AS (
  SELECT *, early IS NULL AND (live_before <> (action = 'Add')) AS accepted FROM {name}_before),
{name} AS (
  SELECT *, CASE WHEN accepted THEN NULL WHEN early IS NOT NULL THEN early
    WHEN action = 'Add' THEN 'exists' ELSE 'absent' END AS reject_reason
  FROM {name}_decided)"""


_MUTATIONS = f"""mutations AS (
  SELECT CAST(user_id AS VARCHAR) AS key, event_id AS seq, {_ACTION} AS action, value, ts FROM events)"""
_DECIDED = _decide("decided", "mutations", "key")
_HISTORY = """history AS (
  SELECT *, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS superseded_by FROM decided WHERE accepted)"""


def _current(name: str, source: str, keys: str) -> str:
    return f"""{name} AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY seq DESC) AS newest
    FROM {source} WHERE accepted) WHERE newest = 1 AND action <> 'Delete')"""


def _path(kind: str, key: str, action: str, seq: str) -> str:
    archived = f"sha256({key}) || '.' || {_uuid('version', seq)}"
    return (
        f"CASE WHEN {kind} = 'Form' OR {action} = 'Add' THEN sha256({key}) || '.current' "
        f"ELSE {archived} END"
    )


_LOG = f"""log AS (
  SELECT seq, {_uuid('log', 'seq')} AS id, 'Bytes' AS kind, CAST(NULL AS VARCHAR) AS template, action,
    {_path("'Bytes'", 'key', 'action', 'seq')} AS new_path
  FROM decided WHERE accepted)"""
_ENTRY = "seq, id, kind, template, action, new_path"

_TEMPLATE_MUTATIONS = f"""template_mutations AS (
  SELECT {_MIXED} AS template, event_id AS seq, {_CHANGE_ACTION} AS action,
    CASE WHEN {_K} % 2 = 0 THEN 'note' ELSE 'detail' END AS extra
  FROM events WHERE {_CHANGE})"""
_TEMPLATE_OUTCOMES = _decide("template_outcomes", "template_mutations", "template")
_SPANS = """spans AS (
  SELECT * FROM (SELECT template, seq AS seq_from, action, extra,
      lead(seq) OVER (PARTITION BY template ORDER BY seq) AS seq_to
    FROM template_outcomes WHERE accepted) WHERE action <> 'Delete')"""
_FORM_MUTATIONS = f"""form_mutations AS (
  SELECT m.*, s.seq_from AS generation, s.extra FROM (
    SELECT {_MIXED} AS template, CAST(user_id AS VARCHAR) AS key, event_id AS seq, {_ACTION} AS action
    FROM events WHERE NOT {_CHANGE}) m
  LEFT JOIN spans s ON m.template = s.template AND m.seq > s.seq_from
    AND (s.seq_to IS NULL OR m.seq < s.seq_to))"""
_GENERATION_KEYS = "template, coalesce(generation, -1), key"
_FORM_OUTCOMES = _decide(
    "form_outcomes",
    "form_mutations",
    _GENERATION_KEYS,
    "CASE WHEN generation IS NULL THEN 'no_template' END",
)
_CASCADE = (_TEMPLATE_MUTATIONS, _TEMPLATE_OUTCOMES, _SPANS, _FORM_MUTATIONS, _FORM_OUTCOMES)

# The mixed batch: sequence numbers are spread so that the kinds interleave.
_MIXED_FORM_OUTCOMES = _decide(
    "form_outcomes",
    "form_mutations",
    _GENERATION_KEYS,
    """CASE WHEN action <> 'Delete' AND seq % 13 = 0 THEN 'bad_team'
      WHEN generation IS NULL THEN 'no_template'
      WHEN action <> 'Delete' AND (seq % 19 = 0 OR (extra = 'note' AND seq % 17 = 0))
        THEN 'breaks_template' END""",
)
_TURN_ACTION = """CASE WHEN turn % 5 = 0 OR (turn % 5 = 3 AND role = 'assistant') THEN 'Add'
    WHEN turn % 5 = 4 THEN 'Delete' ELSE 'Edit' END"""
_TURNS = f"""turns AS (
  SELECT 'conv_' || CAST(conv_id AS VARCHAR) AS key, ((conv_id + turn) * (conv_id + turn + 1) // 2 + turn) * 4 + 1 AS seq,
    {_TURN_ACTION} AS action, turn, role FROM conversations)"""
_TURN_OUTCOMES = _decide("turn_outcomes", "turns", "key")
_PAGE_ACTION = """CASE WHEN page_id % 8 IN (0, 2, 6) THEN 'Add'
    WHEN page_id % 8 = 4 OR page_id % 16 = 7 THEN 'Delete' ELSE 'Edit' END"""
_PAGES = f"""page_changes AS (
  SELECT 'blob_' || CAST(page_id // 8 AS VARCHAR) AS key, page_id * 4 + 2 AS seq,
    {_PAGE_ACTION} AS action, html FROM pages)"""
_PAGE_OUTCOMES = _decide("page_outcomes", "page_changes", "key")
_OUTCOMES = """outcomes AS (
  SELECT seq * 4 AS seq, 'Template' AS kind, CAST(NULL AS VARCHAR) AS template,
    CAST(NULL AS BIGINT) AS generation, template AS key, action, accepted, reject_reason
  FROM template_outcomes
  UNION ALL SELECT seq * 4, 'Form', template, generation * 4, key, action, accepted, reject_reason
  FROM form_outcomes
  UNION ALL SELECT seq, 'Schedule', NULL, NULL, key, action, accepted, reject_reason FROM turn_outcomes
  UNION ALL SELECT seq, 'Bytes', NULL, NULL, key, action, accepted, reject_reason FROM page_outcomes
  UNION ALL SELECT page_id * 4 + 3, CASE WHEN page_id % 2 = 0 THEN 'Video' END, NULL, NULL, url, 'Add', false,
    'bad_mutation' FROM pages)"""
_MIXED_BATCH = (
    _TEMPLATE_MUTATIONS,
    _TEMPLATE_OUTCOMES,
    _SPANS,
    _FORM_MUTATIONS,
    _MIXED_FORM_OUTCOMES,
    _TURNS,
    _TURN_OUTCOMES,
    _PAGES,
    _PAGE_OUTCOMES,
    _OUTCOMES,
)
_OUTCOME_SQL = _with(*_MIXED_BATCH) + "SELECT * FROM outcomes"
_MIXED_LOG_SQL = _with(*_MIXED_BATCH) + f"""SELECT seq, {_uuid('log', 'seq')} AS id, kind, template, action,
  {_path('kind', 'key', 'action', 'seq')} AS new_path FROM outcomes WHERE accepted"""

_LOG_ENTRIES = f"""entries AS (
  SELECT event_id AS seq, {_uuid('log', 'event_id')} AS id,
    CASE event_type WHEN 'view' THEN 'Form' WHEN 'click' THEN 'Bytes' WHEN 'signup' THEN 'Schedule'
      ELSE 'Template' END AS kind,
    CASE WHEN event_type = 'view' THEN {_MIXED} END AS template, {_ACTION} AS action, props AS new_path
  FROM events)"""
_DECODED_LOG_SQL = _with(_LOG_ENTRIES) + (
    "SELECT *, CAST(NULL AS VARCHAR) AS reject_reason FROM entries"
)

_KNOWN = "template <> 'error'"
_VALID = "event_id % 19 <> 0 AND event_id % 17 <> 0"
_AFTER = f"seq > (SELECT seq FROM log WHERE id = '{_cursor(CURSOR_SEQ)}')"
_LOG_CTES = (_MUTATIONS, _DECIDED, _LOG)

_LEDGER_FORMS_SQL = (
    _with(*_MIXED_BATCH[:5], _current("live", "form_outcomes", _GENERATION_KEYS), _FORMS)
    + f"""SELECT l.template, l.generation * 4 AS generation, l.key AS id,
  {", ".join(name for name in _FLAT.split(", ") if name not in ("template", "id"))}, n_fields
FROM live l JOIN spans s ON l.template = s.template AND l.generation = s.seq_from
JOIN forms f ON f.event_id = l.seq WHERE s.seq_to IS NULL"""
)

_LEDGER_GET_SQL = (
    _with(*_MIXED_BATCH[:5], _current("live", "form_outcomes", _GENERATION_KEYS), _FORMS)
    + f"""SELECT w.template, w.id, l.seq IS NOT NULL AS found, l.generation * 4 AS generation,
  {", ".join(name for name in _FLAT.split(", ") if name not in ("template", "id"))}
FROM (SELECT DISTINCT {_MIXED} AS template, CAST(user_id AS VARCHAR) AS id FROM events) w
LEFT JOIN (SELECT v.* FROM live v JOIN spans s ON v.template = s.template AND v.generation = s.seq_from
  WHERE s.seq_to IS NULL) l ON w.template = l.template AND w.id = l.key
LEFT JOIN forms f ON f.event_id = l.seq"""
)
_PAGES_TWICE = f"""twice AS (
  SELECT 'blob_' || CAST(page_id // 8 AS VARCHAR) AS key,
    page_id * 4 + 2 + round * (SELECT max(page_id * 4) - min(page_id * 4) + 1 FROM pages) AS seq,
    {_PAGE_ACTION} AS action, html FROM pages, (VALUES (0), (1)) r(round))"""
_ACCEPTED_PLACES = "accepted AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS place FROM outcomes WHERE accepted)"

ORACLES: dict[str, str] = {
    "forms_filter_none": _filter(),
    "forms_filter_event": _filter("event"),
    "forms_filter_scouter": _filter("scouter"),
    "forms_filter_match": _filter("match_number"),
    "forms_filter_team": _filter("team"),
    "forms_filter_all": _filter(*FILTER),
    "forms_list_ids": _with(_FORMS) + f"SELECT id FROM forms WHERE template = '{TEMPLATE}'",
    "form_get": _with(_FORMS)
    + f"SELECT {_FLAT}, n_fields FROM forms WHERE template = '{TEMPLATE}' AND id = '{FORM_ID}'",
    "form_get_batch": _with(
        _FORMS,
        """wanted AS (SELECT DISTINCT event_type AS template, CAST(event_id * 2 AS VARCHAR) AS id
  FROM events)""",
    )
    + """SELECT w.template, w.id, f.id IS NOT NULL AS found, scouter, team, match_number, event_key,
  score_number, score_rating, k_rating, big, note, detail, x
FROM wanted w LEFT JOIN forms f ON w.template = f.template AND w.id = f.id""",
    "form_field_read": _with(_FORMS)
    + """SELECT template, id, CASE WHEN score_number IS NULL THEN 'Rating' ELSE 'Number' END AS score_tag,
  k_rating AS k, note, CASE WHEN x IS NOT NULL THEN 'Number' END AS x_tag,
  CAST(NULL AS VARCHAR) AS absent_tag FROM forms""",
    "form_field_put": _with(_FORMS)
    + """SELECT template, id, scouter, team, match_number, event_key, CAST(0 AS BIGINT) AS score_number,
  CAST(NULL AS BIGINT) AS score_rating, k_rating, big, note, detail, x, n_fields + 1 AS n_fields,
  true AS seen FROM forms""",
    "template_field_append": _with(_TEMPLATES, _TEMPLATE_FIELDS)
    + """SELECT name, year, pos, field, kind, low, high FROM templates, (
  SELECT * FROM template_fields UNION ALL SELECT 6, 'climb', 'Rating', 1, 9)""",
    "template_build": _with(_TEMPLATES)
    + """SELECT name, CAST(2025 AS BIGINT) AS year, pos, field, kind, low, high FROM templates, (VALUES
  (CAST(0 AS BIGINT), 'auto', 'Title', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)),
  (1, 'speed', 'Rating', 0, 5)) f(pos, field, kind, low, high)""",
    "templates_list": "SELECT DISTINCT event_type AS name FROM events",
    "template_get_batch": _with(
        _TEMPLATES,
        "wanted AS (SELECT event_type AS name FROM events UNION SELECT role FROM conversations)",
    )
    + """SELECT w.name, t.name IS NOT NULL AS found, t.year,
  CASE WHEN t.name IS NOT NULL THEN CAST(6 AS BIGINT) END AS n_fields
FROM wanted w LEFT JOIN templates t ON w.name = t.name""",
    "schedules_list": (
        "SELECT DISTINCT 'conv_' || CAST(conv_id AS VARCHAR) AS event FROM conversations"
    ),
    "schedule_get_batch": _with(
        _SCHEDULES,
        """wanted AS (SELECT DISTINCT 'conv_' || CAST(conv_id * 2 AS VARCHAR) AS event
  FROM conversations)""",
    )
    + """SELECT w.event, s.event IS NOT NULL AS found, pos, scouter, station, match_start, match_end
FROM wanted w LEFT JOIN shifts s ON w.event = s.event""",
    "blob_list_keys": "SELECT url AS key FROM pages",
    "blob_get_batch": """WITH wanted AS (SELECT url AS key FROM pages UNION SELECT reverse(url) FROM pages)
SELECT w.key, p.url IS NOT NULL AS found, sha256(p.url) AS key_sha256,
  sha256(p.html) AS payload_sha256, strlen(p.html) AS n_bytes
FROM wanted w LEFT JOIN pages p ON w.key = p.url""",
    "blob_encode": f"""SELECT url AS key, octet_length({_BLOB}) AS n_bytes,
  sha256({_BLOB}) AS content_sha256 FROM pages""",
    "blob_roundtrip": """SELECT url AS key, sha256(url) AS key_sha256, sha256(html) AS payload_sha256
FROM pages""",
    "form_documents_decode": _with(_FORMS, f"faults AS (SELECT *, {_FAULT} AS fault FROM forms)")
    + "SELECT event_id, template, fault AS reject_reason, "
    + "CASE WHEN fault IS NULL AND event_id % 47 <> 0 THEN id END AS id, "
    + ", ".join(
        f"CASE WHEN fault IS NULL THEN {name} END AS {name}"
        for name in _FLAT.split(", ")
        if name not in ("template", "id")
    )
    + " FROM faults",
    "forms_to_json": f"""SELECT CAST(event_id AS VARCHAR) AS id, {_JSON} AS doc
FROM (SELECT *, {_K} AS k FROM events)""",
    "schedules_to_json": """SELECT DISTINCT 'conv_' || CAST(conv_id AS VARCHAR) AS event,
  '{"event":"conv_' || CAST(conv_id AS VARCHAR) || '"}' AS row FROM conversations""",
    "log_union_decode": _DECODED_LOG_SQL,
    "validate_forms": _with(_FORMS)
    + f"SELECT template, id, {_KNOWN} AS template_known, {_KNOWN} AND {_VALID} AS valid FROM forms",
    "validate_violations": _with(_FORMS)
    + f"""SELECT template, id, 'score' AS field, 'Number' AS expected, 'Rating' AS found,
  'type_mismatch' AS reason FROM forms WHERE {_KNOWN} AND event_id % 19 = 0
UNION ALL SELECT template, id, 'note', 'ShortText', NULL, 'missing'
FROM forms WHERE {_KNOWN} AND event_id % 17 = 0
UNION ALL SELECT template, id, NULL, NULL, NULL, 'unknown_template' FROM forms WHERE NOT ({_KNOWN})""",
    "validate_rejects": _with(_FORMS)
    + f"""SELECT template, id,
  CASE WHEN {_KNOWN} THEN 'breaks_template' ELSE 'unknown_template' END AS reject_reason
FROM forms WHERE NOT ({_KNOWN} AND {_VALID})""",
    "mutations_accept": _with(_MUTATIONS, _DECIDED)
    + "SELECT key, seq, action, live_before, accepted FROM decided",
    "current_state": _with(_MUTATIONS, _DECIDED, _current("live", "decided", "key"))
    + "SELECT key, seq, action, value FROM live",
    "version_history": _with(_MUTATIONS, _DECIDED, _HISTORY)
    + f"""SELECT key, seq, action, superseded_by,
  CASE WHEN superseded_by IS NOT NULL THEN {_uuid('version', 'superseded_by')} END AS version_id
FROM history WHERE action <> 'Delete'""",
    "schedule_mutations": _with(_TURNS, _TURN_OUTCOMES)
    + "SELECT key, seq, action, accepted, reject_reason FROM turn_outcomes",
    "schedules_current": _with(_TURNS, _TURN_OUTCOMES, _current("live", "turn_outcomes", "key"))
    + """SELECT key, seq, CAST(0 AS BIGINT) AS pos, role AS scouter, turn % 6 AS station,
  turn * 10 AS match_start, turn * 10 + 9 AS match_end FROM live""",
    "blob_mutations": _with(_PAGES, _PAGE_OUTCOMES)
    + "SELECT key, seq, action, accepted, reject_reason FROM page_outcomes",
    "blobs_current": _with(_PAGES, _PAGE_OUTCOMES, _current("live", "page_outcomes", "key"))
    + "SELECT key, seq, sha256(html) AS payload_sha256 FROM live",
    "template_generations": _with(*_CASCADE[:3])
    + f"""SELECT template, seq_from AS generation, seq_from, seq_to,
  CASE WHEN seq_to IS NOT NULL THEN {_uuid('version', 'seq_to')} END AS version_id FROM spans""",
    "form_mutations": _with(*_CASCADE)
    + "SELECT template, key, seq, action, generation, accepted, reject_reason FROM form_outcomes",
    "forms_current": _with(*_CASCADE, _current("live", "form_outcomes", _GENERATION_KEYS))
    + """SELECT l.template, generation, key, seq FROM live l
JOIN spans s ON l.template = s.template AND l.generation = s.seq_from WHERE s.seq_to IS NULL""",
    "forms_submit": _with(_FORMS, f"faults AS (SELECT *, {_FAULT} AS fault FROM forms)")
    + f"""SELECT event_id * 2 + 1 AS seq, template, 2 * min(event_id) OVER (PARTITION BY template) AS generation,
  {_uuid('record', 'event_id * 2 + 1')} AS key,
  CASE WHEN fault IS NULL THEN {_uuid('record', 'event_id * 2 + 1')} END AS id,
  fault IS NULL AND {_VALID} AS accepted,
  CASE WHEN fault IS NOT NULL THEN fault WHEN NOT ({_VALID}) THEN 'breaks_template' END AS reject_reason
FROM faults""",
    "mixed_outcomes": _OUTCOME_SQL,
    "mixed_change_log": _MIXED_LOG_SQL,
    "ledger_outcomes": _OUTCOME_SQL,
    "ledger_change_log": _MIXED_LOG_SQL,
    "ledger_feed_stream": _MIXED_LOG_SQL,
    "ledger_forms": _LEDGER_FORMS_SQL,
    "ledger_forms_filter": _LEDGER_FORMS_SQL
    + f" AND l.template = '{LEDGER_TEMPLATE}' AND scouter = '{FILTER['scouter']}'",
    "ledger_get_batch": _LEDGER_GET_SQL,
    "ledger_two_writers": _with(_PAGES_TWICE, _decide("twice_outcomes", "twice", "key"))
    + "SELECT seq, key, action, accepted, reject_reason FROM twice_outcomes",
    "ledger_intake_stream": _with(
        *_MIXED_BATCH, "places AS (SELECT seq, row_number() OVER (ORDER BY seq) - 1 AS place FROM outcomes)"
    )
    + """SELECT p.place AS seq, kind, template, g.place AS generation, key, action, accepted, reject_reason
FROM outcomes o JOIN places p ON p.seq = o.seq LEFT JOIN places g ON g.seq = o.generation""",
    "blob_lossy_keys": "SELECT url || chr(65533) AS key, sha256(html) AS payload_sha256 FROM pages",
    "store_partly_absent": "SELECT DISTINCT 'templates' AS kind, event_type AS key FROM events",
    "change_log_entries": _with(*_LOG_CTES) + f"SELECT {_ENTRY} FROM log",
    "sync_first": _with(*_LOG_CTES) + f"SELECT {_ENTRY} FROM log ORDER BY seq LIMIT 1",
    "sync_after": _with(*_LOG_CTES) + f"SELECT {_ENTRY} FROM log WHERE {_AFTER} ORDER BY seq LIMIT 1",
    "sync_after_unknown": _with(*_LOG_CTES) + f"SELECT {_ENTRY} FROM log WHERE false",
    "sync_drain": _with(*_LOG_CTES) + f"SELECT {_ENTRY} FROM log WHERE {_AFTER}",
    "sync_consumers": _with(
        *_LOG_CTES,
        f"""cursors AS (SELECT event_id AS consumer,
    CASE WHEN event_id % 3 <> 0 THEN {_uuid('log', 'user_id')} END AS cursor FROM events)""",
        "followed AS (SELECT id, lead(seq) OVER (ORDER BY seq) AS next_seq FROM log)",
        """asked AS (SELECT consumer, cursor, CASE WHEN cursor IS NULL THEN (SELECT min(seq) FROM log)
    ELSE next_seq END AS next_seq FROM cursors LEFT JOIN followed ON cursor = id)""",
    )
    + """SELECT consumer, cursor, l.seq, l.id, l.kind, l.template, l.action, l.new_path
FROM asked LEFT JOIN log l ON next_seq = l.seq""",
    "change_feed_stream": _with(*_LOG_CTES) + f"SELECT {_ENTRY} FROM log",
    "artifact_age": _with(_MUTATIONS, _DECIDED, _HISTORY)
    + f"""SELECT key, seq, CAST(trunc((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 86400) AS BIGINT) AS days,
  CAST(floor(epoch(ts)) AS BIGINT) AS created FROM history WHERE action <> 'Delete'""",
    "artifact_location": _with(
        *_CASCADE,
        f"""history AS (SELECT *, lead(seq) OVER (PARTITION BY {_GENERATION_KEYS} ORDER BY seq)
    AS superseded_by FROM form_outcomes WHERE accepted)""",
    )
    + f"""SELECT h.template, h.generation, h.key, h.seq, 'forms/' || sha256(h.template) || '.'
  || CASE WHEN s.seq_to IS NULL THEN 'current' ELSE {_uuid('version', 's.seq_to')} END
  || '/' || sha256(h.key) || '.'
  || CASE WHEN superseded_by IS NULL THEN 'current' ELSE {_uuid('version', 'superseded_by')} END AS path
FROM history h JOIN spans s ON h.template = s.template AND h.generation = s.seq_from
WHERE h.action <> 'Delete'""",
    "store_forms": _with(_FORMS) + f"SELECT {_FLAT}, n_fields FROM forms",
    "store_forms_of_one": _with(_FORMS)
    + f"SELECT {_FLAT}, n_fields FROM forms WHERE template = '{TEMPLATE}'",
    "store_schedules_strict": _with(_SCHEDULES)
    + "SELECT event, pos, scouter, station, match_start, match_end FROM shifts",
    "store_into_ledger": _with(_FORMS) + f"SELECT {_FLAT}, n_fields FROM forms WHERE {_VALID}",
    "store_history_versions": _with(*_MIXED_BATCH, _ACCEPTED_PLACES)
    + """SELECT a.place, a.kind, a.template, g.place AS generation, a.key, a.action, a.accepted,
  a.action <> 'Delete' AS content,
  CASE WHEN a.action <> 'Delete' THEN e.user_id END AS team,
  CASE WHEN a.action <> 'Delete' THEN e.event_id % 80 + 1 END AS match_number,
  CASE WHEN a.action <> 'Delete' THEN sha256(p.html) END AS payload_sha256,
  CASE WHEN a.action <> 'Delete' THEN t.turn * 10 END AS match_start,
  CASE WHEN a.action <> 'Delete' THEN 1704067200 + a.seq END AS committed
FROM accepted a LEFT JOIN accepted g ON g.seq = a.generation
LEFT JOIN events e ON a.kind = 'Form' AND e.event_id * 4 = a.seq
LEFT JOIN pages p ON a.kind = 'Bytes' AND p.page_id * 4 + 2 = a.seq
LEFT JOIN turn_outcomes t ON a.kind = 'Schedule' AND t.seq = a.seq""",
    "store_history_log": _with(*_MIXED_BATCH, _ACCEPTED_PLACES)
    + f"""SELECT place, {_uuid('log', 'seq')} AS id, kind, template, action,
  {_path('kind', 'key', 'action', 'seq')} AS new_path FROM accepted""",
    "store_schedules": _with(_SCHEDULES)
    + "SELECT event, pos, scouter, station, match_start, match_end FROM shifts",
    "store_blobs": """SELECT url AS key, sha256(url) AS key_sha256, sha256(html) AS payload_sha256
FROM pages""",
    "store_log": _DECODED_LOG_SQL,
    "artifact_locations": _with(
        _MUTATIONS, _DECIDED, _HISTORY, *_CASCADE[:3], _TURNS, _TURN_OUTCOMES,
        """turn_history AS (SELECT *, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS superseded_by
  FROM turn_outcomes WHERE accepted)""",
        f"""versions AS (
  SELECT 'Bytes' AS kind, 'bytes' AS folder, key, seq, superseded_by FROM history WHERE action <> 'Delete'
  UNION ALL SELECT 'Schedule', 'schedules', key, seq, superseded_by FROM turn_history WHERE action <> 'Delete'
  UNION ALL SELECT 'Template', 'templates', template, seq_from, seq_to FROM spans)""",
    )
    + f"""SELECT kind, key, seq, folder || '/' || sha256(key) || '.'
  || CASE WHEN superseded_by IS NULL THEN 'current' ELSE {_uuid('version', 'superseded_by')} END AS path
FROM versions""",
    "file_inventory": """SELECT sha256(url) || '.current' AS file, 8 + strlen(url) + strlen(html) AS length
FROM pages""",
    "store_lists": """SELECT DISTINCT 'template' AS kind, event_type AS name FROM events
UNION ALL SELECT DISTINCT 'schedule', 'conv_' || CAST(conv_id AS VARCHAR) FROM conversations""",
}
