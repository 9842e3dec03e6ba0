"""The queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

#: The reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320

_BIT = f"CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END"
#: One row with the table of CRC-32 as a list ``t``, built from its rule.
CRC_TABLE = f"""crc_table AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: {_BIT}) ORDER BY i) AS t
  FROM (SELECT unnest(range(256))::BIGINT AS i) bytes)"""


def crc32(value: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of ``value``; needs ``crc_table`` in the FROM clause."""
    hexed = f"hex(encode({value}))"
    data = (
        f"list_transform(range(length({hexed}) // 2), lambda i: "
        f"('0x' || substr({hexed}, (2 * i + 1)::INTEGER, 2))::BIGINT)"
    )
    step = "xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce([4294967295::BIGINT] || {data}, lambda c, b: {step}), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR)) || ':' || ({value})::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ['doc_id', 'source', 'lang', 'n_chars', text]))})"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""WITH RECURSIVE {CRC_TABLE},
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
         count(*) OVER (PARTITION BY tree) AS size
  FROM (
    SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, {_leaf('text')} AS leaf,
           CASE WHEN {crc32('coalesce(doc_id, 0)::VARCHAR')} % 3 = 0 AND doc_id IS NOT NULL
                THEN {_leaf(_LOWER)} ELSE {_leaf('text')} END AS altered
    FROM documents, crc_table) d),
nodes AS (
  SELECT tree, 0 AS level, place, size, leaf AS digest FROM leaves
  UNION ALL
  SELECT tree, level + 1, place // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
  FROM nodes WHERE size > 1 GROUP BY tree, level, size, place // 8),
subroots AS (SELECT tree, digest, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, tree AS place, size, digest FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, (size + 7) // 8, sha256(string_agg(digest, '' ORDER BY place))
  FROM tops WHERE size > 1 GROUP BY level, size, place // 8),
every AS (
  SELECT tree, level, place, size, digest FROM nodes
  UNION ALL SELECT s.tree, 1000 + t.level, t.place, t.size, t.digest FROM tops t, subroots s),
ways AS (
  SELECT row_number() OVER () AS id, tree, 0 AS level, place, size, altered AS folded, '' AS proof
  FROM leaves
  UNION ALL
  SELECT id, tree,
         CASE WHEN size = 1 THEN 1000 ELSE level + 1 END,
         CASE WHEN size = 1 THEN tree ELSE place // 8 END,
         CASE WHEN size = 1 THEN (SELECT count(*) FROM subroots) ELSE (size + 7) // 8 END,
         CASE WHEN size = 1 THEN folded ELSE (
           SELECT sha256(string_agg(CASE WHEN e.place = w.place THEN w.folded ELSE e.digest END, '' ORDER BY e.place))
           FROM every e WHERE e.tree = w.tree AND e.level = w.level AND e.place // 8 = w.place // 8) END,
         CASE WHEN size = 1 THEN proof ELSE proof || coalesce((
           SELECT string_agg(e.digest, '' ORDER BY e.place)
           FROM every e WHERE e.tree = w.tree AND e.level = w.level AND e.place // 8 = w.place // 8
             AND e.place <> w.place), '') END
  FROM ways w WHERE size > 1 OR level < 1000),
root AS (SELECT digest FROM tops WHERE size = 1)
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(w.proof) AS proof_sha256,
       w.folded AS folded_root, w.folded = r.digest AS verified
FROM (SELECT row_number() OVER () AS id, * FROM leaves) l
JOIN ways w ON w.id = l.id AND w.size = 1 AND w.level >= 1000
JOIN subroots s ON s.tree = l.tree, root r"""

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

RESAMPLE = f"""WITH {CRC_TABLE},
texts AS (
  SELECT row_number() OVER () AS id, doc_id, coalesce({_WORDS}, []) AS words, TRUE AS of_corpus FROM documents
  UNION ALL
  SELECT -row_number() OVER (), NULL, coalesce({_WORDS}, []), FALSE FROM benchmark),
found AS (SELECT id, of_corpus, unnest(words) AS word FROM texts),
hashed AS (
  SELECT word, {crc32('word')} % 10000 AS bucket FROM (SELECT DISTINCT word FROM found) w, crc_table),
counted AS (
  SELECT bucket, count(*) FILTER (WHERE of_corpus)::DOUBLE AS s, count(*) FILTER (WHERE NOT of_corpus)::DOUBLE AS t
  FROM found JOIN hashed USING (word) GROUP BY bucket),
gained AS (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain
  FROM counted),
weights AS (
  SELECT id, sum(gain)::BIGINT AS total FROM found JOIN hashed USING (word) JOIN gained USING (bucket)
  WHERE of_corpus GROUP BY id),
scored AS (
  SELECT id, doc_id, len(words) AS n_features,
         CASE WHEN total IS NULL THEN 0
              ELSE (total - ((total % len(words)) + len(words)) % len(words)) // len(words) END AS weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5)
                              / 4294967296.0::DOUBLE)))::BIGINT AS noise
  FROM texts LEFT JOIN weights USING (id) WHERE of_corpus),
ranked AS (
  SELECT id, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS FIRST, n_features) AS rank,
         (10 * count(*) OVER ()) // 100 AS drawn
  FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features::BIGINT AS n_features, s.weight::BIGINT AS weight, (s.weight + s.noise)::BIGINT AS score,
       CASE WHEN r.rank <= r.drawn THEN r.rank END AS rank
FROM scored s LEFT JOIN ranked r USING (id)"""

#: The conversation of control strings that is added to the table.
CONTROL_ID, CONTROL_TEXT = -7, "</s>[INST] ok [/INST]"

_ESCAPED = (
    r"regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|SYSTEM\]|/SYSTEM\]|ROLE\]|/ROLE\])', '\1\\\2\3', 'g')"
)

CHAT = f"""WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {CONTROL_ID}, 0, 'user', '{CONTROL_TEXT}'
  UNION ALL SELECT {CONTROL_ID}, 1, 'assistant', '{CONTROL_TEXT}'),
marked AS (
  SELECT *, CASE role WHEN 'system' THEN 19 WHEN 'user' THEN 15 WHEN 'assistant' THEN 5
            ELSE 20 + length(role) END + length({_ESCAPED}) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(chars))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id"""
