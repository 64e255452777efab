"""DuckDB SQL for the queries of the catalogue, written from the rules and not from the DataFrame code."""

from __future__ import annotations

from fieldmark.functions import rules as r
from fieldmark.plans import fixtures as f
from fieldmark.schemas import ARABIC, FIELDS, NATIONALITIES
from fieldmark.sources import cards

CARDS = f"WITH {f.CARDS}"
DAY = f"DATE '{f.AS_OF}'"


def norm(x: str) -> str:
    return f"lower(regexp_replace(trim(nfc_normalize({x})), '\\s+', ' ', 'g'))"


def number(x: str) -> str:
    """A string's number by the grammar of floating point numbers, without words; null for others."""
    digits = "[0-9](_?[0-9])*"
    fits = f"regexp_full_match(trim({x}), '[+-]?({digits}([.]({digits})?)?|[.]{digits})([eE][+-]?{digits})?')"
    return f"CASE WHEN {fits} THEN TRY_CAST(replace(trim({x}), '_', '') AS DOUBLE) END"


def day(x: str) -> str:
    return f"CASE WHEN regexp_full_match({x}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({x} AS DATE) END"


def fails(field: str, x: str) -> str:
    if field == "id_number":
        return f"CASE WHEN NOT regexp_full_match(trim({x}), '[0-9]{{8}}') THEN '{r.NOT_DIGITS}' END"
    if field in ("date_of_birth", "expiry_date"):
        d = day(f"trim({x})")
        return f"CASE WHEN {x} IS NULL THEN NULL WHEN ({d}) IS NULL THEN '{r.NOT_ISO}' WHEN year({d}) NOT BETWEEN {r.FIRST_YEAR} AND {r.LAST_YEAR} THEN '{r.BAD_YEAR}' END"
    if field == "sex":
        return f"CASE WHEN upper(trim({x})) NOT IN ('M', 'F') THEN '{r.NOT_SEX}' END"
    if field == "nationality":
        known = ", ".join(f"'{n}'" for n in NATIONALITIES)
        return f"CASE WHEN upper(trim({x})) NOT IN ({known}) THEN '{r.UNKNOWN_NATIONALITY}' END"
    return f"CASE WHEN length(trim({x})) < 2 THEN '{r.SHORT_NAME}' WHEN regexp_matches(trim({x}), '[0-9]') THEN '{r.DIGIT_NAME}' END"


def fails_arabic(field: str, x: str) -> str:
    return f"CASE WHEN NOT regexp_matches({x}, '{r.ARABIC_SCRIPT}') THEN '{r.NOT_ARABIC}' END" if field in ARABIC else "NULL"


def crosses(field: str, t: str) -> str:
    born, ends = f"({day(f'{t}.date_of_birth')})", f"({day(f'{t}.expiry_date')})"
    late = f"WHEN {ends} <= {born} THEN '{r.BEFORE_BIRTH}'"
    if field == "date_of_birth":
        return f"CASE WHEN {born} > {DAY} THEN '{r.FUTURE_BIRTH}' WHEN date_diff('day', {born}, {DAY}) > {r.MAX_AGE_DAYS} THEN '{r.TOO_OLD}' {late} END"
    return f"CASE {late} END" if field == "expiry_date" else "NULL"


def _merged() -> str:
    parts = []
    for i, field in enumerate(FIELDS):
        arabic = field in ARABIC
        same = f"{norm(f'a.{field}')} IS NOT DISTINCT FROM {norm(f'b.{field}')}" + (f" AND {norm(f'a.{field}_ar')} IS NOT DISTINCT FROM {norm(f'b.{field}_ar')}" if arabic else "")
        parts.append(
            f"SELECT a.doc_id, {i} AS ordinal, '{field}' AS field, a.{field} AS value, {f'a.{field}_ar' if arabic else 'NULL'} AS ar, b.doc_id IS NULL AS absent, a.{field} IS NULL AND b.{field} IS NULL AS missing, {same} AS same, "
            f"coalesce({fails(field, f'a.{field}')}, {fails_arabic(field, f'a.{field}_ar')}, {crosses(field, 'a')}) AS fails FROM a LEFT JOIN b ON a.doc_id = b.doc_id"
        )
    return (
        f"m0 AS ({' UNION ALL '.join(parts)}), m AS (SELECT doc_id, ordinal, field, value, CASE WHEN NOT missing THEN ar END AS value_ar, "
        "CASE WHEN missing THEN 'missing' WHEN absent OR NOT same OR fails IS NOT NULL THEN 'review' ELSE 'ok' END AS status, "
        "CASE WHEN missing THEN NULL WHEN absent THEN 'consistency pass unavailable' WHEN NOT same THEN 'passes disagreed' ELSE fails END AS reason, "
        "CASE WHEN NOT missing AND NOT absent THEN 1 ELSE 0 END AS compared, CASE WHEN NOT missing AND NOT absent AND same THEN 1 ELSE 0 END AS matched FROM m0)"
    )


MERGED = f"{CARDS}, {_merged()}"


def _wanted() -> str:
    parts = [f"SELECT doc_id, '{x}' AS field, {x} AS want, {f'{x}_ar' if x in ARABIC else 'NULL'} AS want_ar FROM t" for x in FIELDS]
    empty = lambda x: f"coalesce({norm(x)}, '')"
    return (
        f"{MERGED}, w AS ({' UNION ALL '.join(parts)}), c AS (SELECT m.*, w.want, w.want_ar, {empty('m.value')} = {empty('w.want')} AS correct, "
        f"CASE WHEN w.want_ar IS NOT NULL THEN {empty('m.value_ar')} = {empty('w.want_ar')} END AS correct_ar FROM m JOIN w ON m.doc_id = w.doc_id AND m.field = w.field)"
    )


SCORED = _wanted()
SILENT = (
    "SELECT doc_id, field, coalesce(value, '') AS got, coalesce(want, '') AS expected FROM c WHERE status = 'ok' AND NOT correct "
    "UNION ALL SELECT doc_id, field || '_ar', coalesce(value_ar, ''), want_ar FROM c WHERE status = 'ok' AND NOT correct_ar"
)

KNOWN = ", ".join(f"'{x}'" for x in FIELDS)
RAW = f"WITH raw AS ({f.BOXES})"
CLAIMS = f"{RAW}, k AS (SELECT *, count(*) OVER (PARTITION BY doc_id, x1, y1, x2, y2) AS claims FROM raw WHERE field IN ({KNOWN}))"
SCALED = "s AS (SELECT doc_id, field, CAST(round_even(x1 * 2.0, 0) AS INT) AS x1, CAST(round_even(y1 * 2.0, 0) AS INT) AS y1, CAST(round_even(x2 * 2.0, 0) AS INT) AS x2, CAST(round_even(y2 * 2.0, 0) AS INT) AS y2 FROM {src})"
FILTERED = (
    f"{CLAIMS}, u AS (SELECT * FROM k WHERE claims <= 2), {SCALED.format(src='u')}, "
    "q AS (SELECT doc_id, field, greatest(0, x1) AS x1, greatest(0, y1) AS y1, least(2000, x2) AS x2, least(1200, y2) AS y2 FROM s WHERE x1 >= -40 AND y1 >= -24 AND x2 <= 2040 AND y2 <= 1224), "
    "kept AS (SELECT * FROM q WHERE x2 > x1 AND y2 > y1 AND CAST(x2 - x1 AS DOUBLE) * (y2 - y1) / 2400000.0 BETWEEN 0.0005 AND 0.4 "
    "AND CAST(x2 - x1 AS DOUBLE) / (y2 - y1) BETWEEN 0.5 AND 30.0 AND CAST(y2 - y1 AS DOUBLE) / 1200.0 BETWEEN 0.01 AND 0.25)"
)
PAIRS = (
    f"{FILTERED}, tr AS (SELECT doc_id, field, x1 + doc_id % 40 AS tx1, y1 AS ty1, x2 + doc_id % 40 AS tx2, y2 AS ty2 FROM raw WHERE field IN ({KNOWN}) AND x2 > x1 AND y2 > y1), "
    "p AS (SELECT tr.*, kept.x1, kept.y1, kept.x2, kept.y2, tx1 * 2 AS a1, ty1 * 2 AS b1, tx2 * 2 AS a2, ty2 * 2 AS b2 FROM tr LEFT JOIN kept ON tr.doc_id = kept.doc_id AND tr.field = kept.field), "
    "o AS (SELECT *, least(x2, a2) - greatest(x1, a1) AS iw, least(y2, b2) - greatest(y1, b1) AS ih FROM p), "
    "v AS (SELECT *, CASE WHEN iw > 0 AND ih > 0 THEN CAST(iw * ih AS DOUBLE) / ((x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - iw * ih) ELSE 0.0 END AS iou FROM o)"
)

TEXT = f"WITH d AS ({f.TEXT}), l AS (SELECT doc_id, i, trim(x) AS line FROM (SELECT doc_id, unnest(string_split_regex(text, '\\r?\\n')) AS x, generate_subscripts(string_split_regex(text, '\\r?\\n'), 1) AS i FROM d) q WHERE trim(x) <> '')"
LABELS = (
    ("Name", r"\b(?:full\s*name|name)\b\s*[:.\-]\s*(.+)"),
    ("ID number", r"\b(?:id|civil|national)\s*(?:no|number|#)\b\s*[:.\-]\s*([A-Z0-9\-]{5,})"),
    ("Passport no", r"\b(?:passport)\s*(?:no|number|#)?\b\s*[:.\-]\s*([A-Z0-9]{6,})"),
    ("Date of birth", r"\b(?:date\s*of\s*birth|dob|birth)\b\s*[:.\-]\s*(.+)"),
    ("Expiry date", r"\b(?:expiry|expires|expiration|valid\s*until)\b\s*[:.\-]\s*(.+)"),
    ("Nationality", r"\b(?:nationality|citizenship)\b\s*[:.\-]\s*(.+)"),
    ("Sex", r"\b(?:sex|gender)\b\s*[:.\-]\s*([A-Za-z]+)"),
    ("Reference", r"\b(?:invoice|ref|reference)\s*(?:no|number|#)?\b\s*[:.\-]\s*([A-Z0-9\-/]{3,})"),
    ("Total", r"\b(?:total|amount\s*due)\b\s*[:.\-]?\s*([A-Z]{0,3}\s?[\d,.]+)"),
)
LABEL_SQL = TEXT + " SELECT doc_id, key, arg_min(value, i) AS value FROM (" + " UNION ALL ".join(f"SELECT doc_id, i, '{k}' AS key, trim(regexp_extract(line, '(?i){p}', 1)) AS value FROM l" for k, p in LABELS) + ") q WHERE value <> '' GROUP BY doc_id, key"


def first_match(pattern: str, name: str) -> str:
    return f"WITH d AS ({f.TEXT}) SELECT doc_id, {name} FROM (SELECT doc_id, regexp_extract(text, '{pattern}', 0) AS {name} FROM d) q WHERE {name} <> ''"


WORDS = f"WITH d AS ({f.TEXT}), w AS (SELECT doc_id, i, word, 50.0 + (doc_id * 7 + i * 13) % 50 AS confidence FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM d) q)"

HITS = "count(*) FILTER (x1 IS NOT NULL AND iou >= 0.5) AS hits, count(*) FILTER (x1 IS NOT NULL) AS {total}, count(*) AS {expected}, count(*) FILTER (x1 IS NOT NULL) * 100.0::DOUBLE / count(*) AS coverage, count(*) FILTER (x1 IS NOT NULL AND iou >= 0.5) * 100.0::DOUBLE / count(*) FILTER (x1 IS NOT NULL) AS hit_rate FROM v"
LATENCY = f"e AS ({f.LATENCY}), n AS (SELECT elapsed_ms, row_number() OVER (ORDER BY elapsed_ms) AS rn, count(*) OVER () AS n FROM e WHERE elapsed_ms IS NOT NULL)"
MEDIAN = "min(elapsed_ms) FILTER (rn = n // 2 + 1) AS median_ms, max(elapsed_ms) AS max_ms FROM n"

FALLBACKS = (
    ("Date found", r"regexp_extract_all(text, '\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b', 0)[1]"),
    ("Date found (2)", r"regexp_extract_all(text, '\b\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}\b', 0)[2]"),
    ("Number", r"nullif(regexp_extract(text, '\b\d{7,14}\b', 0), '')"),
    ("Machine-readable line", "nullif(regexp_extract(text, '[A-Z0-9<]{25,}', 0), '')"),
    ("Name (uncertain)", "(SELECT arg_min(l.line, l.i) FROM l WHERE l.doc_id = d.doc_id AND regexp_full_match(l.line, '[A-Z][A-Z\\s''\\-]{7,}'))"),
    ("Email", r"nullif(regexp_extract(text, '[\w.+\-]+@[\w\-]+\.[\w.]{2,}', 0), '')"),
)
FOUND = (
    TEXT + ", y AS (SELECT doc_id, k, key, min(i) AS i, arg_min(value, i) AS value FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, i, {k} AS k, '{name}' AS key, trim(regexp_extract(line, '(?i){p}', 1)) AS value FROM l" for k, (name, p) in enumerate(LABELS))
    + ") q WHERE value <> '' GROUP BY doc_id, k, key UNION ALL SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, {k} AS k, '{name}' AS key, 1000000000 AS i, {x} AS value FROM d" for k, (name, x) in enumerate(FALLBACKS))
    + ") z WHERE value IS NOT NULL), found AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS INT) AS ordinal, key, value FROM y)"
)


def _manifest() -> str:
    """The fields of customers' cards with the boxes that the table of widths gives their values."""
    wide = f"list_sum(list_transform(string_split(want, ''), lambda c: CASE WHEN contains('{cards.NARROW.replace(chr(39), chr(39) * 2)}', c) THEN {cards.NARROW_WIDTH} WHEN contains('{cards.WIDE}', c) THEN {cards.WIDE_WIDTH} ELSE {cards.PLAIN_WIDTH} END + {cards.GAP})) - {cards.GAP}"
    at, m = cards.Layout(), cards.MARGIN
    each = " UNION ALL ".join(f"SELECT doc_id, '{field}' AS field, {field} AS want, {f'{field}_ar' if field in ARABIC else 'NULL'} AS want_ar, {at.rows()[field]} AS y FROM t" for field in FIELDS)
    return f"""WITH t AS ({f.TRUTH}), e AS ({each}) SELECT 'card_' || CAST(doc_id AS STRING) || '.png' AS image, field, want, want_ar,
{at.left - m} AS x1, y - {m} AS y1, CAST(least({at.left} + {wide}, {at.width}) + {m} AS INT) AS x2, y + {at.glyph + m} AS y2 FROM e"""


ORACLE = {
    "validate_cards": f"{MERGED} SELECT doc_id, ordinal, field, value, value_ar, status, reason FROM m",
    "agreement_counts": f"{MERGED} SELECT doc_id, CAST(sum(matched) AS INT) AS matched, CAST(sum(compared) AS INT) AS compared, 6 AS total, CASE WHEN sum(compared) = 0 THEN '—' ELSE CAST(CAST(sum(matched) AS INT) AS STRING) || '/' || CAST(CAST(sum(compared) AS INT) AS STRING) END AS label FROM m GROUP BY doc_id",
    "status_histogram": f"{MERGED} SELECT status, count(*) AS n FROM m GROUP BY status",
    "found_fields": f"{MERGED} SELECT doc_id, CAST(count(*) FILTER (status <> 'missing') AS INT) AS found FROM m GROUP BY doc_id",
    "format_reasons": CARDS + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{x}' AS field, {fails(x, x)} AS reason FROM a" for x in FIELDS) + ") q WHERE reason IS NOT NULL",
    "arabic_reasons": CARDS + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{x}' AS field, {fails_arabic(x, f'{x}_ar')} AS reason FROM a" for x in ARABIC) + ") q WHERE reason IS NOT NULL",
    "cross_field_reasons": CARDS + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{x}' AS field, {crosses(x, 'a')} AS reason FROM a" for x in ("date_of_birth", "expiry_date")) + ") q WHERE reason IS NOT NULL",
    "nationality_unknown": CARDS + " SELECT doc_id, nationality FROM a WHERE " + fails("nationality", "nationality") + " IS NOT NULL",
    "per_field_accuracy": f"{SCORED} SELECT min(ordinal) AS ordinal, field, count(*) FILTER (correct) AS exact, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'missing') AS missing, count(*) AS n FROM c GROUP BY field",
    "silent_errors": f"{SCORED} {SILENT}",
    "silent_error_rate": f"{SCORED}, e AS ({SILENT}) SELECT (SELECT count(*) FROM e) AS n_silent, count(*) AS total, (SELECT count(*) FROM e) * 100.0::DOUBLE / count(*) AS percent FROM c",
    "box_shared_claims": f"{CLAIMS} SELECT doc_id, field, claims FROM k",
    "box_rescale": f"{RAW}, {SCALED.format(src='raw')} SELECT doc_id, field, x1, y1, x2, y2 FROM s",
    "box_filter": f"{FILTERED} SELECT doc_id, field, x1, y1, x2, y2 FROM kept",
    "iou_hits": PAIRS + " SELECT " + HITS.format(total="total", expected="expected"),
    "latency_summary": f"WITH {LATENCY} SELECT {MEDIAN}",
    "text_labels": LABEL_SQL,
    "text_dates": rf"WITH d AS ({f.TEXT}), x AS (SELECT doc_id, regexp_extract_all(text, '\b\d{{1,2}}[/\-.]\d{{1,2}}[/\-.]\d{{2,4}}\b', 0) AS dates FROM d) SELECT doc_id, dates[1] AS first_date, dates[2] AS second_date FROM x WHERE len(dates) > 0",
    "text_long_numbers": first_match(r"\b\d{7,14}\b", "number"),
    "text_mrz": first_match("[A-Z0-9<]{25,}", "machine_line"),
    "text_caps_names": TEXT + " SELECT doc_id, arg_min(line, i) AS name FROM l WHERE regexp_full_match(line, '[A-Z][A-Z\\s''\\-]{7,}') GROUP BY doc_id",
    "text_emails": first_match(r"[\w.+\-]+@[\w\-]+\.[\w.]{2,}", "email"),
    "word_confidence": rf"{WORDS}, n AS (SELECT doc_id, trim(regexp_extract(line, '(?i){LABELS[0][1]}', 1)) AS value FROM ({TEXT[TEXT.index('l AS (') + 6 : -1]}) l WHERE i = 1) SELECT n.doc_id, n.value, round(avg(w.confidence), 6) AS confidence FROM n LEFT JOIN w ON w.doc_id = n.doc_id AND list_contains(list_filter(string_split_regex(upper(n.value), '\s+'), lambda x: x <> ''), regexp_replace(upper(w.word), '[^\w<@.\-/]', '', 'g')) GROUP BY n.doc_id, n.value",
    "mean_confidence": f"{WORDS} SELECT doc_id, CAST(floor(avg(confidence) + 0.5) AS INT) AS mean_confidence, CAST(count(*) AS INT) AS word_count FROM w GROUP BY doc_id",
    "strip_fences": f"WITH r AS ({f.REPLIES}), b AS (SELECT doc_id, regexp_replace(regexp_replace(trim(text), '(?i)^\\s*```(?:json)?\\s*', ''), '\\s*```\\s*$', '') AS x FROM r), p AS (SELECT doc_id, x, instr(x, '{{') AS s, CASE WHEN instr(x, '}}') > 0 THEN length(x) - instr(reverse(x), '}}') + 1 ELSE 0 END AS e FROM b) SELECT doc_id, CASE WHEN s > 0 AND e > s THEN substr(x, s, e - s + 1) ELSE trim(x) END AS json FROM p",
    "parse_card_json": f"SELECT * FROM ({f.REPLY_OUTCOME}) q",
    "parse_boxes_json": f"{RAW} SELECT doc_id, field, x1, y1, x2, y2 FROM raw WHERE doc_id % 7 <> 3",
    "retry_resolution": f"WITH o AS ({f.REPLY_OUTCOME}) SELECT doc_id, CASE WHEN error IS NULL THEN full_name WHEN doc_id % 2 = 0 THEN 'RETRIED' END AS full_name, error IS NOT NULL AS was_retried, error IS NOT NULL AND doc_id % 2 = 1 AS all_missing FROM o",
    "resize_policy": f"WITH z AS ({f.SIZES}), y AS (SELECT *, CASE WHEN greatest(w, h) > 1600 THEN 1600.0::DOUBLE / greatest(w, h) WHEN greatest(w, h) < 900 THEN least(2.0::DOUBLE, 900.0::DOUBLE / greatest(w, h)) ELSE 1.0::DOUBLE END AS k FROM z) SELECT doc_id, CAST(floor(w * k + 0.5) AS INT) AS out_w, CAST(floor(h * k + 0.5) AS INT) AS out_h FROM y",
    "props_parse": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "box_attach": f"{FILTERED} SELECT r.doc_id, r.field, k.x1, k.y1, k.x2, k.y2 FROM (SELECT doc_id, field FROM raw WHERE field IN ({KNOWN})) r LEFT JOIN kept k ON r.doc_id = k.doc_id AND r.field = k.field",
    "request_fanout": "SELECT c_custkey AS doc_id, reading, 1 AS attempt, CASE reading WHEN 'B' THEN 'contrast' ELSE 'original' END AS variant, reading = 'C' AS asks_for_boxes FROM customer, (SELECT unnest(['A', 'B', 'C']) AS reading) r",
    "transcriptions": "SELECT conv_id * 1000 + turn AS doc_id, trim(text) AS text FROM conversations WHERE role = 'assistant'",
    "confidence_classes": "WITH e AS (SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(floor(value) AS BIGINT) % 101 END AS c FROM events) SELECT event_id, CASE WHEN c IS NULL THEN 'mid' WHEN c >= 85 THEN 'ok' WHEN c >= 65 THEN 'mid' ELSE 'low' END AS class, CASE WHEN c IS NULL THEN 'n/a' ELSE CAST(c AS STRING) || '%' END AS label FROM e",
    "stream_transcripts": "SELECT conv_id, turn, trim(text) AS text FROM conversations WHERE role = 'assistant'",
    "page_escape": "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages",
    "text_fields": FOUND + " SELECT doc_id, ordinal, key, value FROM found",
    "export_fields": FOUND + WORDS.replace("WITH d AS", ", dd AS").replace("FROM d)", "FROM dd)") + ", m AS (SELECT doc_id, CAST(floor(avg(confidence) + 0.5) AS INT) AS mean_confidence, CAST(count(*) AS INT) AS word_count FROM w GROUP BY doc_id) SELECT m.doc_id, found.key, found.value, mean_confidence, word_count, 0 AS elapsed_ms FROM m LEFT JOIN found ON found.doc_id = m.doc_id",
    "response_fields": f"{MERGED} SELECT doc_id, field, value, value_ar, status, reason, CASE field WHEN 'full_name' THEN 200 END AS x1, CASE field WHEN 'full_name' THEN 100 END AS y1, CASE field WHEN 'full_name' THEN 800 END AS x2, CASE field WHEN 'full_name' THEN CAST(160 + 2 * (doc_id % 20) AS INT) END AS y2, CAST(sum(matched) OVER (PARTITION BY doc_id) AS INT) AS matched, CAST(sum(compared) OVER (PARTITION BY doc_id) AS INT) AS compared, 6 AS total, 'scripted' AS model FROM m",
    "contrast_pixels": "WITH h AS (SELECT doc_id, md5(CAST(doc_id AS STRING)) AS x FROM documents), g AS (SELECT doc_id, list_transform(range(0, 16), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS INT)) AS g FROM h), "
    "y AS (SELECT *, list_transform(g, lambda v: v::FLOAT * 0.299::FLOAT + v::FLOAT * 0.587::FLOAT + v::FLOAT * 0.114::FLOAT) AS y FROM g) "
    "SELECT doc_id, list_min(g) AS low, list_max(g) AS high, 48 AS bytes, array_to_string(list_transform(y, lambda v: repeat(printf('%02x', CAST(trunc((v - list_min(y)) / greatest(1::FLOAT, list_max(y) - list_min(y)) * 255::FLOAT) AS INT)), 3)), '') AS pixels FROM y",
    "odd_box_numbers": f"WITH o AS ({f.ODD_NUMBERS}), n AS (SELECT doc_id, {number('a')} AS x1, {number('b')} AS x2 FROM o), "
    "w AS (SELECT doc_id, CASE WHEN abs(x1) < 2147483648 THEN CAST(round_even(x1, 0) AS INT) END AS x1, CASE WHEN abs(x2) < 2147483648 THEN CAST(round_even(x2, 0) AS INT) END AS x2 FROM n) "
    "SELECT doc_id, 'sex' AS field, x1, 1 AS y1, x2, 1 AS y2 FROM w WHERE x1 IS NOT NULL AND x2 IS NOT NULL UNION ALL SELECT doc_id, 'full_name', 1, 2, 3, 4 FROM w WHERE doc_id % 4 = 2",
    "odd_card_numbers": "SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 2 THEN '1e400' WHEN 3 THEN CAST(c_custkey AS VARCHAR) END AS full_name, CASE WHEN c_custkey % 4 > 1 THEN CAST(c_custkey AS VARCHAR) END AS id_number, c_custkey % 4 < 2 AS failed FROM customer",
    "manifest_truth": _manifest(),
    "image_scan": "SELECT 'card_' || CAST(c_custkey AS STRING) || '.png' AS image, CASE WHEN c_custkey % 17 = 3 THEN -1 ELSE 640 END AS width, CASE WHEN c_custkey % 17 = 3 THEN -1 ELSE 330 END AS height, c_custkey % 17 <> 3 AS readable, CASE WHEN c_custkey % 17 <> 3 THEN 6 END AS exact_boxes, 6 AS stated_boxes FROM customer",
    "image_rejects": "SELECT 'card_' || CAST(c_custkey AS STRING) || '.png' AS name, 'not an image that can be read' AS error FROM customer WHERE c_custkey % 17 = 3",
    "observed_metrics": f"SELECT count(DISTINCT doc_id) AS rows, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'review') AS review, count(*) FILTER (status = 'missing') AS missing, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(compared) AS BIGINT) AS compared FROM ({MERGED} SELECT * FROM m) m",
    "batched_replies": "SELECT doc_id, 'T' AS reading, CAST(length(coalesce(text, '')) AS VARCHAR) || ':' || left(coalesce(text, ''), 12) AS text FROM documents",
    "grid_sizes": f"WITH z AS ({f.SIZES}), y AS (SELECT doc_id, w * CASE WHEN doc_id % 5 = 1 THEN 31 ELSE 1 END AS w, h * CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END AS h FROM z), "
    "x AS (SELECT *, CASE WHEN w > 0 AND h > 0 THEN greatest(w, h) <= 200 * least(w, h) ELSE false END AS fits, greatest(28, round_even(w / 28.0::DOUBLE, 0) * 28) AS nw, greatest(28, round_even(h / 28.0::DOUBLE, 0) * 28) AS nh, sqrt(w * h / 1003520.0::DOUBLE) AS small, CASE WHEN w * h > 0 THEN sqrt(200704.0::DOUBLE / (w * h)) END AS large FROM y), "
    "s AS (SELECT *, CASE WHEN NOT fits THEN NULL WHEN nw * nh > 1003520 THEN greatest(28, floor(w / small / 28) * 28) WHEN nw * nh < 200704 THEN ceil(w * large / 28) * 28 ELSE nw END AS sw, CASE WHEN NOT fits THEN NULL WHEN nw * nh > 1003520 THEN greatest(28, floor(h / small / 28) * 28) WHEN nw * nh < 200704 THEN ceil(h * large / 28) * 28 ELSE nh END AS sh FROM x) "
    "SELECT doc_id, CAST(sw / 14 AS INT) AS across, CAST(sh / 14 AS INT) AS down, CAST(coalesce(sw, w) AS INT) AS pw, CAST(coalesce(sh, h) AS INT) AS ph FROM s",
    "log_lines": f"{MERGED} SELECT doc_id, 'extract elapsed_ms=' || CAST(doc_id * 37 % 9000 AS STRING) || ' agreement=' || CAST(CAST(sum(matched) AS INT) AS STRING) || '/6 ok=' || CAST(count(*) FILTER (status = 'ok') AS STRING) || ' review=' || CAST(count(*) FILTER (status = 'review') AS STRING) || ' missing=' || CAST(count(*) FILTER (status = 'missing') AS STRING) AS line FROM m GROUP BY doc_id",
    "score_summary": f"{SCORED}, se AS ({SILENT}), {PAIRS.removeprefix('WITH ')}, bx AS (SELECT {HITS.format(total='boxes', expected='boxes_expected')}), {LATENCY}, t2 AS (SELECT {MEDIAN}) SELECT (SELECT count(*) FROM se) AS n_silent, count(*) AS total, (SELECT count(*) FROM se) * 100.0::DOUBLE / count(*) AS percent, any_value(b2.hits) AS hits, any_value(b2.boxes) AS boxes, any_value(b2.boxes_expected) AS boxes_expected, any_value(b2.coverage) AS coverage, any_value(b2.hit_rate) AS hit_rate, any_value(t2.median_ms) AS median_ms, any_value(t2.max_ms) AS max_ms, true AS comparable FROM c, bx b2, t2",
    "missing_truth": "SELECT c_custkey AS doc_id FROM customer WHERE c_custkey % 10 = 3",
    "processed_sizes": FILTERED.replace("x1 * 2.0", "x1 * k").replace("y1 * 2.0", "y1 * k").replace("x2 * 2.0", "x2 * k").replace("y2 * 2.0", "y2 * k").replace("FROM u)", "FROM (SELECT *, CASE WHEN doc_id % 2 = 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS k FROM u) z)") + " SELECT doc_id, field, x1, y1, x2, y2 FROM kept",
    "boxes_off": "SELECT c_custkey AS doc_id, 'A' AS reading, 1 AS attempt, 'original' AS variant FROM customer",
    "display_labels": "WITH c AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey * 7 % 100 <> 50 THEN c_custkey * 7 % 5000 END AS ms, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 101 END AS sure FROM customer) SELECT id, CASE WHEN ms IS NOT NULL THEN printf('%.1fs', ms / 1000.0::DOUBLE) END AS seconds, name AS model, CASE id % 3 WHEN 0 THEN 'http://a' || CAST(id AS STRING) WHEN 1 THEN 'http://b' ELSE '' END AS address, CASE id % 3 WHEN 0 THEN '#00B3A4' WHEN 1 THEN '#E0952C' ELSE '#D2544B' END AS status_colour, CASE WHEN sure >= 85 THEN '#00B3A4' WHEN sure >= 65 THEN '#E0952C' ELSE '#D2544B' END AS confidence_colour FROM c",
    "display_classes": f"{MERGED} SELECT doc_id, field, CASE field WHEN 'full_name' THEN 'Name' WHEN 'id_number' THEN 'ID number' WHEN 'date_of_birth' THEN 'Date of birth' WHEN 'expiry_date' THEN 'Expiry' WHEN 'nationality' THEN 'Nationality' ELSE 'Sex' END AS label, CASE status WHEN 'ok' THEN 'ok' WHEN 'review' THEN 'mid' ELSE 'low' END AS class FROM m",
}
ORACLE["stream_extraction"] = f"SELECT field, status, reason, count(*) AS n, count(x1) AS boxes, CAST(sum(coalesce(length(value), 0)) AS BIGINT) AS chars, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(compared) AS BIGINT) AS compared FROM ({ORACLE['response_fields']}) r GROUP BY field, status, reason"
# Arabic values of the fixture, and the presentation forms that are seen of them from left to right.
SHAPES = {
    "جون سميث": "FE9A FEF4 FEE4 FEB3 0020 FEE5 FEEE FE9F", "أحمد سعيد": "FEAA FEF4 FECC FEB3 0020 FEAA FEE4 FEA3 FE83", "فاطمة علي": "FEF2 FEE0 FECB 0020 FE94 FEE4 FEC3 FE8E FED3",
    "عماني": "FEF2 FEE7 FE8E FEE4 FECB", "هندي": "FEF1 FEAA FEE8 FEEB", "ذكر": "FEAE FEDB FEAB", "أنثى": "FEF0 FE9C FEE7 FE83",
}
_SEEN = ", ".join(f"('{word}', '{''.join(chr(int(c, 16)) for c in codes.split())}')" for word, codes in SHAPES.items())
ORACLE["arabic_shapes"] = f"WITH t AS ({f.TRUTH}), s(word, seen) AS (VALUES {_SEEN}) SELECT doc_id, a.seen AS full_name, b.seen AS nationality, c.seen AS sex FROM t JOIN s a ON a.word = full_name_ar JOIN s b ON b.word = nationality_ar JOIN s c ON c.word = sex_ar"
