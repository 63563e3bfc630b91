"""Registered queries of this subpackage: thin digests of what its operators return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom.llm import bpe, collocations, decontaminate, licenses, lm, minhash, preferences
from vitaloom.llm import prefixes, quality, rules, substrings, toxicity, warc
from vitaloom.plans.inputs import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.near_duplicate_passages(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents")).drop("ids")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preferences.pairs_of_answers(table(spark, sf_dir, "conversations"))
    return preferences.format_pairs(turns).select(
        "pair_id",
        "n_prefix",
        "prompt",
        "chosen",
        "rejected",
        _told("chosen_spans").alias("chosen_spans"),
        _told("rejected_spans").alias("rejected_spans"),
    )


def _told(spans: str) -> Column:
    """Spans as start:length, comma-joined."""
    one = lambda s: F.concat(s["start"], F.lit(":"), s["length"])
    return F.when(F.col(spans).isNotNull(), F.concat_ws(",", F.transform(spans, one)))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "license_id", F.concat_ws(",", "notices").alias("notices")
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


def op11_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.prefix_trie(table(spark, sf_dir, "conversations")).drop("node")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumns(
        {
            "n_offending": F.size("offending").cast("long"),
            "offending": F.array_join(
                F.transform("offending", lambda x: F.concat(x["start"], F.lit(":"), x["end"])), ","
            ),
        }
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality": op3_quality,
    "op4_substrings": op4_substrings,
    "op5_bpe": op5_bpe,
    "op6_warc": op6_warc,
    "op7_preferences": op7_preferences,
    "op8_licenses": op8_licenses,
    "op9_lm": op9_lm,
    "op10_rules": op10_rules,
    "op11_prefixes": op11_prefixes,
    "op12_toxicity": op12_toxicity,
    "op13_collocations": op13_collocations,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op1_minhash": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s
  FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY ALL),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * k >= 75 * (x.n + y.n - k)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY ALL)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)""",
    "op2_decontaminate": rf"""
WITH w AS (SELECT doc_id,
    regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id,
    regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(ws), 10) AS n,
    unnest(list_transform(range(1, greatest(len(ws) - 9, 1) + 1),
      lambda i: array_to_string(ws[i:i + 9], ' '))) AS s
  FROM b WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
runs AS (SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws
  FROM w JOIN lengths ON len(ws) >= n),
hits AS (SELECT doc_id, i, r.n, item_id
  FROM (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS s FROM runs) r
  JOIN windows USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY ALL),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY ALL)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_warc": """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), m AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END
    AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM p JOIN m USING (payload_digest)""",
    "op7_preferences": """
WITH conv AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations
  WHERE conv_id IS NOT NULL),
answers AS (SELECT pair_id, max(turn) AS last_turn,
    max({'turn': turn, 'text': text}).text AS answer
  FROM conv WHERE role = 'assistant' GROUP BY ALL),
swaps AS (SELECT a.pair_id, a.last_turn, b.answer AS other
  FROM answers a JOIN answers b ON b.pair_id = a.pair_id + 1),
sides AS (
  SELECT pair_id, 'c' AS side, turn, role, text FROM conv
  UNION
  SELECT pair_id, 'r', turn, role, text FROM conv JOIN swaps USING (pair_id)
  WHERE turn < last_turn
  UNION
  SELECT pair_id, 'r', last_turn, 'assistant', other FROM swaps),
placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text)
    AS i FROM sides),
sizes AS (SELECT pair_id, count(*) FILTER (side = 'c') AS nc, count(*) FILTER (side = 'r') AS nr
  FROM sides GROUP BY ALL),
differs AS (SELECT c.pair_id, min(c.i) AS i FROM placed c JOIN placed r
    ON c.pair_id = r.pair_id AND c.i = r.i AND c.side = 'c' AND r.side = 'r'
  WHERE c.role IS DISTINCT FROM r.role OR c.text IS DISTINCT FROM r.text GROUP BY ALL),
prefix AS (SELECT pair_id, nr, coalesce(i - 1, least(nc, nr)) AS n
  FROM sizes LEFT JOIN differs USING (pair_id)),
drawn AS (SELECT pair_id, side, i, n, role, coalesce(text, '') AS t,
    '<|im_start|>' || coalesce(role, '') || chr(10) AS head,
    coalesce(text, '') || '<|im_end|>' || chr(10) AS body
  FROM placed JOIN prefix USING (pair_id)),
spans AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (
    PARTITION BY pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + length(head) AS start FROM drawn WHERE i > n)
SELECT p.pair_id, p.n AS n_prefix,
  coalesce((SELECT string_agg(head || body, '' ORDER BY i) FROM drawn d
    WHERE d.pair_id = p.pair_id AND side = 'c' AND i <= d.n), '') AS prompt,
  coalesce((SELECT string_agg(head || body, '' ORDER BY i) FROM spans d
    WHERE d.pair_id = p.pair_id AND side = 'c'), '') AS chosen,
  CASE WHEN p.nr > 0 THEN coalesce((SELECT string_agg(head || body, '' ORDER BY i) FROM spans d
    WHERE d.pair_id = p.pair_id AND side = 'r'), '') END AS rejected,
  coalesce((SELECT string_agg(start || ':' || length(t), ',' ORDER BY i) FROM spans d
    WHERE d.pair_id = p.pair_id AND side = 'c' AND role = 'assistant'), '') AS chosen_spans,
  CASE WHEN p.nr > 0 THEN coalesce((SELECT string_agg(start || ':' || length(t), ',' ORDER BY i)
    FROM spans d WHERE d.pair_id = p.pair_id AND side = 'r' AND role = 'assistant'), '') END
    AS rejected_spans
FROM prefix p""",
    "op11_prefixes": """
WITH turns AS (SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS n_bytes,
    sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32]
      AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS p
  FROM turns),
sizes AS (SELECT conv_id, count(*) AS n FROM own GROUP BY ALL),
-- crc32 of the decimal digits, bit by bit
ids AS (SELECT conv_id, conv_id - conv_id % 5 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, c: list_reduce(list_prepend(xor(crc, c), range(8)),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 9 AS h
  FROM sizes),
placed AS (
  SELECT i.conv_id, o.p, o.digest, o.n_bytes FROM ids i JOIN own o ON o.conv_id = i.base AND o.p <= h
  UNION ALL
  SELECT i.conv_id, o.p - h + least(h, coalesce(b.n, 0)), o.digest, o.n_bytes
  FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.p > h LEFT JOIN sizes b ON b.conv_id = i.base),
rebuilt AS (SELECT i.conv_id,
    coalesce(list(digest ORDER BY p) FILTER (p IS NOT NULL), []) AS path,
    coalesce(list(n_bytes ORDER BY p) FILTER (p IS NOT NULL), []) AS lengths
  FROM ids i LEFT JOIN placed USING (conv_id) GROUP BY i.conv_id),
prefixes AS (SELECT conv_id, len(path) AS size, d AS depth, array_to_string(path[1:d], '') AS node,
    CASE WHEN d > 0 THEN array_to_string(path[1:d - 1], '') END AS parent,
    CASE WHEN d > 0 THEN lengths[d] ELSE 0 END AS n_bytes
  FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT node, depth, any_value(parent) AS parent, any_value(n_bytes) AS n_bytes,
    min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), ''))
      AS ends_sha256
  FROM prefixes GROUP BY node, depth),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
subtrees AS (SELECT p.node, count(*) FILTER (c.n IS NULL) AS n_leaves,
    sum((n.n_convs - 1) * n.n_bytes) AS saved
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth <= n.depth
  LEFT JOIN children c ON c.node = n.node GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  s.n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s USING (node) LEFT JOIN children c USING (node)
LEFT JOIN nodes p ON p.node = n.parent""",
    "op13_collocations": rf"""
WITH pieces AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
sizes AS (SELECT lang, sum(len(ws))::HUGEINT AS n FROM pieces GROUP BY ALL),
grams AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i
    FROM pieces, (SELECT unnest(range(1, 6)) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, phrase, m, count(*)::HUGEINT AS c FROM grams GROUP BY ALL HAVING count(*) >= 100),
parts AS (SELECT lang, phrase, m, c, string_split(phrase, ' ') AS ws FROM f WHERE m > 1),
cuts AS (SELECT lang, phrase, c, k, array_to_string(ws[1:k], ' ') AS head,
    array_to_string(ws[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM parts)),
scored AS (SELECT x.lang, x.phrase, x.c AS a, h.c AS l, t.c AS r, n,
    (1000 * x.c * n) // (h.c * t.c) AS score, k
  FROM cuts x JOIN f h ON h.lang = x.lang AND h.phrase = head
  JOIN f t ON t.lang = x.lang AND t.phrase = tail JOIN sizes s ON s.lang = x.lang),
worst AS (SELECT * FROM scored
  QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, array_to_string(ws[i:i + w - 1], ' ') AS phrase, max(c) AS c
  FROM (SELECT *, unnest(range(1, m - w + 2)) AS i
    FROM (SELECT *, unnest(range(2, m)) AS w FROM parts)) GROUP BY ALL),
left_ AS (SELECT w.* FROM worst w LEFT JOIN inner_ i ON i.lang = w.lang AND i.phrase = w.phrase
  WHERE i.c IS NULL OR 100 * i.c < 100 * w.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM left_ QUALIFY rank <= 2000""",
}
