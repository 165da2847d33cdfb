"""DuckDB SQL for the text queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

SIZES = f"""s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
  ('0x' || substr(md5(concat_ws('/', doc_id::VARCHAR, text)), 1, 15))::BIGINT AS place FROM documents)"""

# Targets by water filling: sources by the level at which they reach their limit; the level is the
# first at which the next source is still below its own.
TARGETS = """g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (
    ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM g),
r AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
  coalesce(sum(3.0::DOUBLE * source_size) OVER o, 0)::DOUBLE AS capped,
  sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
  3.0::DOUBLE * source_size / weight AS own FROM w
  WINDOW o AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT coalesce(arg_min((total - capped) / open_weight, (own, source)) FILTER (WHERE (total - capped) / open_weight < own), 0) AS level FROM r),
t AS (SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * level) AS target FROM w, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t)"""

MIX = f"""WITH {SIZES}, {TARGETS},
c AS (SELECT s.doc_id, s.source, s.size, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size AS budget,
  sum(size) OVER (PARTITION BY s.source, place) AS unit,
  sum(size) OVER (PARTITION BY s.source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source),
x AS (SELECT *, (whole + CASE WHEN budget > 0 AND 2 * (upto - unit) + unit <= 2 * budget THEN 1 ELSE 0 END)::BIGINT AS n FROM c)
SELECT doc_id, size, source_size, target, (n * size)::BIGINT AS taken FROM x"""

LEAKS = r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT row_number() OVER () AS bid, item_id, w, least(5, len(w)) AS k FROM (SELECT item_id,
    list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark) WHERE len(w) > 0),
ds AS (SELECT DISTINCT rid, doc_id, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT rid, doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
        WHERE k IN (SELECT k FROM bw))),
bs AS (SELECT DISTINCT bid, item_id, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT bid, item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bw)),
n AS (SELECT bid, count(*) AS size FROM bs GROUP BY bid),
m AS (SELECT rid, doc_id, bs.bid, bs.item_id, size, count(*) AS found
  FROM ds JOIN bs USING (s) JOIN n ON n.bid = bs.bid GROUP BY ALL HAVING count(*) >= ceil(round(0.8 * size, 6)))
SELECT doc_id, item_id, size::BIGINT AS size, max(found)::BIGINT AS found, max(found) / size AS containment
FROM m GROUP BY doc_id, item_id, size"""


RULES = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM d),
m AS (SELECT d.doc_id, w, len(w)::BIGINT AS n_words, coalesce(length(array_to_string(w, '')), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d JOIN ln USING (rid) LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) / n_words AS capitals,
  len(list_filter(w, lambda x: lower(x) = upper(x) AND NOT regexp_matches(x, '\p{{L}}'))) / n_words AS signs,
  len(list_filter(w, lambda x: length(x) > 40)) / n_words AS long,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) / n_words AS stutter FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars / n_words < 2 OR word_chars / n_words > 14 OR n_symbols > 0.1 * n_words
    OR n_dup_lines > 0.5 * n_lines OR stutter > 0.3 OR capitals > 0.6 OR signs > 0.4 OR long > 0.1) AS kept FROM b"""

# A turn has <s> and </s> and the marks of its role; escaping adds a character for each backslash and control string.
CHAT = r"""WITH said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, role || chr(10) || text || chr(10) AS turn_text, CASE WHEN role = 'assistant' THEN text END AS learned,
  length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?INST\]|<<SYS>>|<</SYS>>|\[ROLE|\[/ROLE\]')) + 7
  + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 WHEN 'assistant' THEN 0
    ELSE 16 + octet_length(encode(role)) * 2 END AS chars FROM said)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(turn_text, '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(learned)), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(learned, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars FROM t GROUP BY conv_id"""

NEGATIVES = """WITH v AS (SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.r AS anchor, c.r AS other, c.vec_id, a.label = c.label AS alike,
  list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v AS a JOIN v AS c ON a.vec_id % 100 = 0 AND a.r <> c.r),
p AS (SELECT * FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  (row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.vec_id))::INT AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor = s.anchor AND NOT s.alike AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10"""


def all_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": MIX,
        "op3_decontaminate": LEAKS,
        "op4_quality_rules": RULES,
        "op12_chat_format": CHAT,
        "op13_hard_negatives": NEGATIVES,
    }
