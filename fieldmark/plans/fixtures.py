"""Inputs derived from the plain tables, in SQL that Spark and DuckDB both run: cards in two readings, boxes, replies, text.

Each text is a relation; names in it are tables (customer, lineitem, events, documents).
"""

from __future__ import annotations

AS_OF = "2026-01-01"

TRUTH = """
SELECT c_custkey AS doc_id,
  CAST(c_mktsegment AS STRING) || ' ' || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(1 + c_custkey % 26 AS INT), 1) AS full_name,
  CASE c_custkey % 3 WHEN 0 THEN 'جون سميث' WHEN 1 THEN 'أحمد سعيد' ELSE 'فاطمة علي' END AS full_name_ar,
  CAST(10000000 + c_custkey AS STRING) AS id_number,
  CAST(1950 + c_custkey % 55 AS STRING) || '-' || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS date_of_birth,
  CAST(2027 + c_custkey % 9 AS STRING) || '-' || lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') || '-' || lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS expiry_date,
  CASE c_custkey % 5 WHEN 0 THEN 'OMANI' WHEN 1 THEN 'INDIAN' WHEN 2 THEN 'FILIPINO' WHEN 3 THEN 'BRITISH' ELSE 'SRI LANKAN' END AS nationality,
  CASE c_custkey % 2 WHEN 0 THEN 'عماني' ELSE 'هندي' END AS nationality_ar,
  CASE c_custkey % 2 WHEN 0 THEN 'M' ELSE 'F' END AS sex,
  CASE c_custkey % 2 WHEN 0 THEN 'ذكر' ELSE 'أنثى' END AS sex_ar,
  c_name
FROM customer"""

FIRST = """
SELECT doc_id,
  CASE WHEN doc_id % 53 = 1 THEN 'J' WHEN doc_id % 59 = 1 THEN c_name ELSE full_name END AS full_name,
  CASE WHEN doc_id % 61 = 1 THEN 'JOHN' ELSE full_name_ar END AS full_name_ar,
  CASE WHEN doc_id % 11 = 1 THEN NULL WHEN doc_id % 13 = 1 THEN substr(id_number, 1, 7) WHEN doc_id % 67 = 2 THEN '99999999' ELSE id_number END AS id_number,
  CASE WHEN doc_id % 17 = 1 THEN '1990-02-31' WHEN doc_id % 19 = 1 THEN '2090-01-01' WHEN doc_id % 23 = 1 THEN '1850-01-01' WHEN doc_id % 29 = 1 THEN '1902-05-05' ELSE date_of_birth END AS date_of_birth,
  CASE WHEN doc_id % 31 = 1 THEN '1940-01-01' WHEN doc_id % 37 = 1 THEN '12/04/2030' ELSE expiry_date END AS expiry_date,
  CASE WHEN doc_id % 41 = 1 THEN 'ATLANTEAN' WHEN doc_id % 43 = 1 THEN lower(nationality) ELSE nationality END AS nationality,
  nationality_ar,
  CASE WHEN doc_id % 47 = 1 THEN 'MALE' ELSE sex END AS sex,
  sex_ar
FROM t"""

SECOND = """
SELECT doc_id,
  CASE WHEN doc_id % 3 = 0 THEN '  ' || lower(full_name) || '  ' ELSE full_name END AS full_name,
  CASE WHEN doc_id % 71 = 3 THEN full_name_ar || 'ي' ELSE full_name_ar END AS full_name_ar,
  CASE WHEN doc_id % 22 = 1 THEN '12345678' WHEN id_number IS NOT NULL AND doc_id % 7 = 3 THEN '00000000' ELSE id_number END AS id_number,
  date_of_birth, expiry_date, nationality, nationality_ar, sex, sex_ar
FROM a WHERE doc_id % 73 <> 5"""

BOXES = """
SELECT l_orderkey AS doc_id,
  CASE l_linenumber WHEN 1 THEN 'full_name' WHEN 2 THEN 'id_number' WHEN 3 THEN 'date_of_birth' WHEN 4 THEN 'expiry_date' WHEN 5 THEN 'nationality' WHEN 6 THEN 'sex' ELSE 'eye_colour' END AS field,
  CAST(CASE WHEN l_orderkey % 5 = 0 THEN 100 ELSE l_partkey % 900 - 10 END AS INT) AS x1,
  CAST(CASE WHEN l_orderkey % 5 = 0 THEN 50 ELSE (l_suppkey * 37) % 580 - 5 END AS INT) AS y1,
  CAST(CASE WHEN l_orderkey % 5 = 0 THEN 400 ELSE l_partkey % 900 - 10 + CAST(l_quantity AS INT) * 8 - 20 END AS INT) AS x2,
  CAST(CASE WHEN l_orderkey % 5 = 0 THEN 90 ELSE (l_suppkey * 37) % 580 - 5 + (l_partkey % 97) END AS INT) AS y2
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn FROM lineitem) q WHERE rn = 1"""

#: Replies whose form depends on the key: plain, fenced, in prose, cut off, with an unknown key, numeric, boolean, blank, no object.
REPLIES = """
SELECT c_custkey AS doc_id,
  CASE c_custkey % 11
    WHEN 0 THEN '{"full_name": "' || c_name || '", "id_number": "' || CAST(10000000 + c_custkey AS STRING) || '"}'
    WHEN 1 THEN '```json' || chr(10) || '{"full_name": "' || c_name || '", "sex": "M"}' || chr(10) || '```'
    WHEN 2 THEN 'Here it is: {"full_name": "' || c_name || '"} as asked.'
    WHEN 3 THEN '{"full_name": "' || c_name
    WHEN 4 THEN '{"full_name": "' || c_name || '", "eye_colour": "brown"}'
    WHEN 5 THEN '{"id_number": ' || CAST(10000000 + c_custkey AS STRING) || '}'
    WHEN 6 THEN '{"full_name": true}'
    WHEN 7 THEN '{"full_name": "", "id_number": "   ", "sex": null}'
    WHEN 8 THEN 'I cannot read this card.'
    WHEN 9 THEN '[1]'
    ELSE '{"full_name": ["' || c_name || '"]}' END AS text
FROM customer"""

#: The same replies' outcome, stated by rule.
REPLY_OUTCOME = """
SELECT c_custkey AS doc_id,
  CASE WHEN c_custkey % 11 IN (0, 1, 2) THEN c_name END AS full_name,
  CASE WHEN c_custkey % 11 IN (0, 5) THEN CAST(10000000 + c_custkey AS STRING) END AS id_number,
  CASE WHEN c_custkey % 11 = 1 THEN 'M' END AS sex,
  CASE WHEN c_custkey % 11 IN (3, 8) THEN 'not valid JSON'
       WHEN c_custkey % 11 = 9 THEN 'expected a JSON object, got list'
       WHEN c_custkey % 11 IN (4, 6, 10) THEN 'does not match the card schema' END AS error
FROM customer"""

TEXT = """
SELECT doc_id,
  'Full name: JOHN ' || CAST(doc_id AS STRING) || chr(10) || 'id no: AB' || CAST(10000 + doc_id AS STRING) || chr(10) || 'passport no. P' || CAST(100000 + doc_id AS STRING) || chr(10)
  || 'dob: 1/2/1990' || chr(10) || 'expiry - 3-4-2030' || chr(10) || 'Nationality: OMANI' || chr(10) || 'sex: M' || chr(10) || 'invoice no: INV-' || CAST(doc_id AS STRING) || chr(10)
  || 'total OMR ' || CAST(doc_id AS STRING) || '.50' || chr(10)
  || CASE WHEN doc_id % 3 = 0 THEN 'JOHN ALEXANDER SMITH' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 4 = 0 THEN 'P<OMNSMITH<<JOHN<<<<<<<<<<<<<<<<' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN 'write to john.' || CAST(doc_id AS STRING) || '@example.com' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN 'call ' || CAST(90000000 + doc_id AS STRING) || chr(10) ELSE '' END
  || text AS text
FROM documents"""

SIZES = "SELECT doc_id, CAST(300 + doc_id % 2400 AS INT) AS w, CAST(200 + doc_id % 1500 AS INT) AS h FROM documents"
LATENCY = "SELECT CAST(floor(value * 100) AS INT) AS elapsed_ms FROM events"

#: The relations that cards need, as a WITH list.
CARDS = f"t AS ({TRUTH}), a AS ({FIRST}), b AS ({SECOND})"
#: Tails of numbers, by row: some make a number, some none.
TAILS = ("", "d", "f", "_0", ".5", "e1", " ", "L", "__1", "_", ".", "e", "e400", "x1")
_TAIL = "CASE CAST({n} AS INT) " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TAILS)) + " END"
_ODD = f"SELECT c_custkey AS doc_id, CONCAT(CASE c_custkey % 5 WHEN 0 THEN '+' WHEN 1 THEN '-' WHEN 2 THEN ' ' ELSE '' END, CAST(c_custkey AS STRING), {_TAIL.format(n=f'c_custkey % {len(TAILS)}')}) AS a, CONCAT(CAST(c_nationkey AS STRING), {_TAIL.format(n=f'c_nationkey % {len(TAILS)}')}) AS b FROM customer"
ODD_NUMBERS = _ODD
ODD_BOXES = f"""SELECT doc_id, CONCAT('{{"sex": ["', a, '", 1, "', b, '", true], "full_name": [1, 2, 3, "', CASE doc_id % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN '1d' WHEN 2 THEN '4' ELSE 'inf' END, '"]}}') AS text FROM ({_ODD}) odd"""
ODD_CARDS = """SELECT c_custkey AS doc_id, CONCAT('{"full_name": ', CASE c_custkey % 4 WHEN 0 THEN '1e400' WHEN 1 THEN '-2E999' WHEN 2 THEN '"1e400"' ELSE CAST(c_custkey AS STRING) END, ', "id_number": "', CAST(c_custkey AS STRING), '"}') AS text FROM customer"""
