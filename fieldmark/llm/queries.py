"""The corpus queries and their SQL; ``__spark_entry__`` adds them if this subpackage is present."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm import bpe, chat, decontam, grulm, heaplloyd, ledger, media, neardup, pii, quality, repair, urltrust, warc
from fieldmark.llm.common import LOWER, UPPER, table

#: The place of the tokenizer's ranks and its pattern are parameters; the defaults are those of the contract.
RANKS = "byte_bpe_multi_50k.tiktoken"


def default_coder(path: str | None = None, pattern: str | None = None) -> bpe.Coder:
    public = importlib.import_module("public_tokenizers")
    return bpe.coder(path or public.path(RANKS), pattern or public.PATTERN)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_turns(rows)).drop("first_invalid")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), default_coder())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), words=4)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrust.url_verdicts(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages"))).drop("url")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_images(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grulm.log_likelihoods(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digest(repair.repair(repair.damaged(table(spark, sf_dir, "conversations")), copies="copies"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heaplloyd.digest(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.digest(table(spark, sf_dir, "documents"))


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each version of the policy keeps of all documents, and would keep without each of its rules."""
    return ledger.ablations(ledger.ledger(table(spark, sf_dir, "documents")))


def host_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts' trust and distrust after eight steps where each page links to that of another number, as the tables' own pages link to no other host."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = F.lit(pages.count())
    target = pages.select(F.col("page_id").alias("to"), F.col("url").alias("there"))
    linked = pages.withColumn("to", F.pmod(F.col("page_id") * 7 + 3, n)).join(target, "to", "left")
    linked = linked.select("page_id", "url", F.concat(F.lit('<a href="'), "there", F.lit('">x</a>')).alias("html"))
    hosts = urltrust.host_verdicts(linked, urltrust.judged_pages(linked), urltrust.Spread(steps=8, tolerance=0.0))
    return hosts.select("host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"), "host_verdict")


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_byte_bpe, op3_pii, op4_near_duplicates, op5_quality, op6_url_filters, op7_warc, op8_media_columns, op9_decontamination, op10_lm_scores, op11_structure_repair, op12_vector_codes, op13_quality_rules, rule_ablations, host_trust)}


def _shingle_sql(table: str, key: str, words: int) -> str:
    """Relations w (key, words) and s (key, shingle) of a table's texts."""
    split = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
    runs = f"CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i : i + {words - 1}], ' ')) END"
    return f"{table}_w AS (SELECT {key}, {split} AS w FROM {table}), {table}_s AS (SELECT DISTINCT {key}, unnest({runs}) AS sh FROM {table}_w), {table}_n AS (SELECT {key}, count(*) AS n FROM {table}_s GROUP BY {key})"


SAID = "'</s>[INST] ok [/INST]'"
CONTROLS = "'\\\\|\\[SYS\\]|\\[/SYS\\]|\\[INST\\]|\\[/INST\\]|<a>|</s>|\\[ROLE\\]|\\[/ROLE\\]|\\[/TURN\\]|<s>'"

def _spread_sql(steps: int) -> str:
    """PageRank over links (src, dst, weight) from seeds, along and against them, one relation a step."""
    parts = []
    for name, links in (("trust", "SELECT src, dst, weight FROM links"), ("distrust", "SELECT dst AS src, src AS dst, weight FROM links")):
        parts.append(f"{name}_e AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM ({links}) q), {name}_0 AS (SELECT host, 0.15 * {name} AS score FROM seeds)")
        parts += [f"{name}_{i} AS (SELECT host, sum(score) AS score FROM (SELECT host, score FROM {name}_0 UNION ALL SELECT dst, 0.85 * share * score FROM {name}_e JOIN {name}_{i - 1} r ON r.host = src) q GROUP BY host)" for i in range(1, steps + 1)]
    return ", ".join(parts)


def _far_sql(steps: int) -> str:
    """As _spread_sql, but what moves in a step is followed alone and summed in the end: with many steps no relation is written for each."""
    parts = []
    for name, links in (("trust", "SELECT src, dst, weight FROM links"), ("distrust", "SELECT dst AS src, src AS dst, weight FROM links")):
        parts.append(f"""{name}_e AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM ({links}) q),
{name}_m AS (SELECT 0 AS k, host, (1 - 0.85::DOUBLE) * {name} AS score FROM seeds WHERE {name} > 0 UNION ALL SELECT k + 1, dst, sum(0.85::DOUBLE * share * score) FROM {name}_m JOIN {name}_e ON src = host WHERE k < {steps} GROUP BY k + 1, dst),
{name}_r AS (SELECT host, sum(score) AS score FROM {name}_m GROUP BY host)""")
    return ", ".join(parts)


#: Pages with their host, path and the longest rule that fits.
JUDGED_SQL = f"""p AS (SELECT page_id, html, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
j AS (SELECT *, CASE WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/' WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN '.' || host LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/' WHEN '.' || host LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
r AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM j)"""
#: Links to other hosts by the html of pages.
LINKS_SQL = f"""h AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)(?:href|src)\\s*=\\s*["'']?((?:https?:)?//[^\\s"''<>]+)', 1)) AS link FROM p),
l AS (SELECT src, translate(regexp_extract(link, '//([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS dst FROM h),
links AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)"""


#: CRC-32 of a text of ASCII characters, x.
CRC32_SQL = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(x, ''), lambda s: ord(s)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"


def _repair_sql() -> str:
    """The least edits of each conversation, row after row: c0 to c3 hold the best way into each state of the grammar, insertions included."""

    def then(v: str, cost: str, label: str, out: str) -> str:
        return f"CASE WHEN {v} IS NOT NULL THEN {{'c': {v}.c + {cost}, 'l': {v}.l || '{label}', 'o': {v}.o || {out}}} END"

    def least(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    user, assistant = (lambda v: then(v, "3", "I", "'user:' || chr(10)")), (lambda v: then(v, "3", "I", "'assistant:' || chr(10)"))
    gone = lambda v: then(v, "4", "D", "''")
    kept = lambda v, x: f"CASE WHEN NOT must AND initial = '{x}' THEN {then(v, 'more', 'K', 'line')} END"
    given = lambda v, role: f"CASE WHEN NOT must THEN {then(v, '3 + more', 'R', f"'{role}:' || text || chr(10)")} END"
    to_user = [f(v) for v in ("c0", "c1", "c3") for f in (lambda v: kept(v, "u"), lambda v: given(v, "user"))]
    step = f"{gone('c0')} AS s0, {least(gone('c1'), kept('c0', 's'))} AS s1, {least(gone('c2'), *to_user)} AS s2, {least(gone('c3'), kept('c2', 'a'), given('c2', 'assistant'))} AS s3"
    closed = f"s0 AS c0, s1 AS c1, {least('s2', user('s0'), user('s1'), user('s3'))} AS c2, {least('s3', assistant('m'))} AS c3"
    middle = f"*, {least('s2', user('s0'), user('s1'))} AS m"
    kind = "STRUCT(c BIGINT, l VARCHAR, o VARCHAR)"
    blank = "trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH RECURSIVE x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS x FROM conversations),
k AS (SELECT *, {CRC32_SQL} % 20 AS kind FROM x),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM k, range(CASE kind WHEN 3 THEN 2 ELSE 1 END) WHERE kind <> 0),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS initial, {blank} AS bare FROM d),
f AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, NOT right(bare, 1) IN ('.', '!', '?') AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM p),
r AS (SELECT *, blank OR again AS must, CASE WHEN cut THEN 3 ELSE 0 END AS more, role || ':' || text || chr(10) AS line FROM f),
w AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, {{'c': 0, 'l': '', 'o': ''}}::{kind} AS c0, NULL::{kind} AS c1, {{'c': 3, 'l': 'I', 'o': 'user:' || chr(10)}}::{kind} AS c2, {{'c': 6, 'l': 'II', 'o': 'user:' || chr(10) || 'assistant:' || chr(10)}}::{kind} AS c3 FROM conversations
UNION ALL SELECT conv_id, pos, {closed} FROM (SELECT {middle} FROM (SELECT r.conv_id, r.pos, {step} FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1) q) q),
b AS (SELECT conv_id, arg_max({least('c0', 'c3')}, pos) AS best FROM w GROUP BY conv_id),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (cut AND NOT must) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.l AS audit,
  length(replace(best.l, 'D', '')) AS n_turns, sha256(substr(best.o, 1, length(best.o) - 1)) AS repaired_sha256
FROM b LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM b.conv_id"""


def _codes_sql(rounds: int = 2) -> str:
    """Codebooks from the first 64 rows, so many rounds, and a last assignment."""
    far = "list_sum(list_transform(list_zip(x, y), lambda q: (q[1] - q[2]) * (q[1] - q[2])))"
    parts = [f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS (SELECT rid, p, z[p * (len(z) // 16) + 1 : (p + 1) * (len(z) // 16)] AS x FROM v, range(16) t(p)),
c0 AS (SELECT p, rid - 1 AS e, x AS y FROM x WHERE rid <= 64)"""]
    for k in range(rounds + 1):
        parts.append(f"a{k} AS (SELECT rid, p, min(struct_pack(far := {far}, e := e)) AS best, any_value(x) AS x FROM x JOIN c{k} USING (p) GROUP BY rid, p)")
        if k < rounds:
            parts.append(f"s{k} AS (SELECT p, best.e AS e, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, range(1, len(x) + 1) t(i) GROUP BY ALL)")
            parts.append(f"m{k} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS y FROM s{k} GROUP BY p, e)")
            parts.append(f"c{k + 1} AS (SELECT c{k}.p, c{k}.e, coalesce(m{k}.y, c{k}.y) AS y FROM c{k} LEFT JOIN m{k} ON m{k}.p = c{k}.p AND m{k}.e = c{k}.e)")
    parts.append(f"r AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)")
    return ", ".join(parts) + f"""
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) FROM c{rounds}) AS codebooks_sha256
FROM r JOIN v USING (rid)"""


#: The ledger: measurements by document (one row each, number rid) and the bits of the rules that fail.
LEDGER_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM t),
o AS (SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS run FROM w, range(1, len(w) - 6) r(i)),
g AS (SELECT rid, i FROM o QUALIFY count(*) OVER (PARTITION BY rid, run) > 1),
c AS (SELECT rid, count(DISTINCT i + k) AS n FROM g, range(8) r(k) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter_words, len(regexp_extract_all(text, '\p{L}')) AS n_letters, len(regexp_extract_all(text, '\p{Lu}')) AS n_capitals,
  coalesce(list_max(list_transform(w, lambda x: length(x))), 0) AS longest_word FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, CAST((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (100 * n_symbols > 20 * n_words)::INT + 8 * (100 * n_dup_lines > 30 * n_lines)::INT + 16 * (100 * n_letter_words < 75 * n_words)::INT + 32 * (100 * n_capitals > 30 * n_letters)::INT
  + 64 * (word_chars < 3 * n_words)::INT + 128 * (word_chars > 12 * n_words)::INT + 256 * (longest_word > 200)::INT AS BIGINT) AS bits FROM m)"""
#: version, masks of rules that reject and that are counted, and how many of the latter may fail.
POLICIES_SQL = "(VALUES ('base', 3, 0, 0), ('lines', 15, 0, 0), ('full', 63, 448, 1)) p(version, rejects, counted, allowed)"
RULES_SQL = "(VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('letterless', 16), ('capitals', 32), ('short_words', 64), ('long_words', 128), ('endless_word', 256)) r(rule, bit)"


#: Those that SQL can express; the others are held against brute force in the tests.
ORACLE_SQL: dict[str, str] = {
    "op1_chat_format": f"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {SAID} UNION ALL SELECT -1, 1, 'assistant', {SAID}),
s AS (SELECT *, row_number() OVER w AS pos, coalesce(lag(CASE WHEN role IN ('system', 'user', 'assistant') THEN role END IGNORE NULLS) OVER w, '') AS before,
  length(text) + len(regexp_extract_all(text, {CONTROLS})) + CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 24 + length(role) + len(regexp_extract_all(role, {CONTROLS})) END AS chars
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
v AS (SELECT *, CASE before WHEN '' THEN role IN ('system', 'user') WHEN 'user' THEN role = 'assistant' ELSE role = 'user' END AS valid FROM s)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, bool_and(valid) AND arg_max(role, pos) FILTER (role IN ('system', 'user', 'assistant')) = 'assistant' AS accepted
FROM v GROUP BY conv_id""",
    "op4_near_duplicates": f"""
WITH RECURSIVE {_shingle_sql('documents', 'doc_id', 4)},
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM documents_s x JOIN documents_s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN documents_n x ON x.doc_id = a JOIN documents_n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN documents_n n ON n.doc_id = d.doc_id JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = d.doc_id""",
    "host_trust": f"""
WITH p AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS (SELECT *, CASE WHEN '.' || host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'allow' WHEN '.' || host LIKE '%.net' AND path LIKE '/%' THEN 'block'
  WHEN '.' || host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'block' WHEN '.' || host LIKE '%.org' AND path LIKE '/fr/%' THEN 'allow' END AS ruled FROM p),
seeds AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS trust, avg(CASE WHEN ruled = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS distrust FROM j GROUP BY host),
links AS (SELECT a.host AS src, b.host AS dst, CAST(count(*) AS DOUBLE) AS weight FROM p a JOIN p b ON b.page_id = (a.page_id * 7 + 3) % (SELECT count(*) FROM pages) WHERE a.host <> b.host GROUP BY a.host, b.host),
{_spread_sql(8)}
SELECT s.host, round(coalesce(t.score, 0), 9) AS trust, round(coalesce(d.score, 0), 9) AS distrust, CASE WHEN coalesce(d.score, 0) - coalesce(t.score, 0) >= 0.075 THEN 'block' ELSE 'allow' END AS host_verdict
FROM seeds s LEFT JOIN trust_8 t ON t.host = s.host LEFT JOIN distrust_8 d ON d.host = s.host""",
    "op6_url_filters": f"""
WITH RECURSIVE {JUDGED_SQL}, {LINKS_SQL},
seeds AS (SELECT host, avg(CASE WHEN ruled = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS trust, avg(CASE WHEN ruled = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS distrust FROM r WHERE host <> '' GROUP BY host),
{_far_sql(60)},
v AS (SELECT host, coalesce(t.score, 0) AS trust, coalesce(d.score, 0) AS distrust FROM seeds LEFT JOIN trust_r t USING (host) LEFT JOIN distrust_r d USING (host))
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN distrust - trust >= 0.5 * (1 - 0.85::DOUBLE) THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust FROM r LEFT JOIN v ON v.host = r.host""",
    "op7_warc": """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to FROM m""",
    "op11_structure_repair": _repair_sql(),
    "op12_vector_codes": _codes_sql(),
    "op13_quality_rules": f"""{LEDGER_SQL}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, bits & 3 <> 0 AS base_failed, bits & 63 = 0 AND bit_count(bits & 448) <= 1 AS kept, bits FROM b""",
    "rule_ablations": f"""{LEDGER_SQL}
SELECT version, rule, count(*) AS n_rows, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits & rejects = 0 AND bit_count(bits & counted) <= allowed) AS n_kept,
  count(*) FILTER (bits & rejects & ~bit = 0 AND bit_count(bits & counted & ~bit) <= allowed) AS n_kept_without
FROM b, {POLICIES_SQL}, {RULES_SQL} WHERE (rejects | counted) & bit <> 0 GROUP BY version, rule""",
    "op9_decontamination": f"""
WITH {_shingle_sql('documents', 'doc_id', 5)}, {_shingle_sql('benchmark', 'item_id', 5)},
p AS (SELECT d.doc_id, b.item_id, count(*) AS c FROM benchmark_s b JOIN documents_s d ON d.sh = b.sh GROUP BY ALL)
SELECT p.doc_id, p.item_id, n.n AS item_shingles, c AS shared_shingles, c / CAST(n.n AS DOUBLE) AS containment FROM p JOIN benchmark_n n ON n.item_id = p.item_id WHERE c / CAST(n.n AS DOUBLE) >= 0.8""",
}
