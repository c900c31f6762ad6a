r"""DuckDB SQL for the queries that SQL can express (decontamination, Jaccard join, chat formatting,
ranked search, licence scan).

The others are trained, approximate or sequential; ``tests/llm`` holds them against brute force, exact
round trips or held-out labels.
"""

from __future__ import annotations

from .license_scan import ANCHORS, BASE, NOTICES, RARE, SHARE, SLACK

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
          "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")

ORACLES: dict[str, str] = {}

ORACLES["op4_wu_manber_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) x
      WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b) x),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lengths) x),
found AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM places p JOIN windows w USING (n, key)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) x GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) x GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLES["op7_chosen_path_jaccard_join"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS key
  FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0) x),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
                    FROM shingles a JOIN shingles b USING (key) WHERE a.doc_id <> b.doc_id GROUP BY ALL) p
  JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 5 * k >= 4 * (s.n + t.n - k)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles,
       least(d.doc_id, coalesce((SELECT min(y) FROM reach WHERE x = d.doc_id), d.doc_id)) AS class_id,
       CAST((SELECT count(*) FROM links WHERE x = d.doc_id) AS BIGINT) AS n_links
FROM d LEFT JOIN sizes s USING (doc_id)"""

_PROBE = "</s>[INST] ok [/INST]"

ORACLES["op10_chat_grammar_round_trip"] = rf"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}')
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(text)
                + len(regexp_extract_all(text, '<\\*/?s>|\[\\*/?INST\]'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


ORACLES["op11_bloom_ranked_search"] = f"""
WITH t AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
d AS (SELECT r, doc_id, w, CAST(len(w) AS BIGINT) AS n FROM t WHERE len(w) > 0),
size AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
tf AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(w) AS term FROM d) x GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
scored AS (
  SELECT item_id, tf.r, any_value(d.doc_id) AS doc_id, CAST(sum(CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT)
         * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN df USING (term) JOIN tf USING (term) JOIN d USING (r), size GROUP BY item_id, tf.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank
           FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10"""


def _license_tables() -> str:
    templates = [*BASE, *NOTICES]
    rows = ", ".join(f"({k}, '{t.label}', {t.base}, '{t.text}', {0 if t.base else SLACK}, {1 if t.base else ANCHORS})"
                     for k, t in enumerate(templates))
    keys = ", ".join(f"({k}, '{key}')" for k, t in enumerate(templates) for key in ((t.text,) if t.base else t.keys))
    return (f"tpl(tid, label, base, txt, play, anchors) AS (VALUES {rows}),\n"
            f"phrases(tid, phrase) AS (VALUES {keys})")


ORACLES["op12_rare_token_license_scan"] = f"""
WITH {_license_tables()},
keys AS (SELECT tid, string_split(phrase, ' ') AS p, play,
                len(string_split(rtrim(split_part(' ' || txt || ' ', ' ' || phrase || ' ', 1)), ' ')) - 1 AS q
         FROM phrases JOIN tpl USING (tid)),
tw AS (SELECT tid, word, min(pos) AS q FROM (
         SELECT tid, unnest(string_split(txt, ' ')) AS word, unnest(range(len(string_split(txt, ' ')))) AS pos FROM tpl) x
       GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
occ AS (SELECT r, word, pos FROM (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d) x
        WHERE word IN (SELECT word FROM tw)),
df AS (SELECT word, count(DISTINCT r) AS df FROM occ GROUP BY word),
weighed AS (
  SELECT tid, word, q, base, play, anchors, coalesce(df, 0) AS df,
         1 + CAST(floor(1000 * ln((n + 1) / (coalesce(df, 0) + 1))) AS BIGINT) AS weight,
         row_number() OVER (PARTITION BY tid ORDER BY coalesce(df, 0), word) AS k
  FROM tw JOIN tpl USING (tid) LEFT JOIN df USING (word), (SELECT count(*) AS n FROM documents) size),
post AS (SELECT * FROM weighed WHERE base OR k <= {RARE}),
total AS (SELECT tid, sum(weight) AS total FROM post GROUP BY tid),
own AS (SELECT r, post.*, row_number() OVER (PARTITION BY r, tid ORDER BY df, word) AS a
        FROM post JOIN (SELECT DISTINCT r, word FROM occ) x USING (word)),
starts AS (SELECT DISTINCT r, tid, pos - q AS s FROM own JOIN occ USING (r, word) WHERE a <= anchors),
found AS (
  SELECT r, tid, s, sum(weight) AS f FROM (
    SELECT DISTINCT starts.r, starts.tid, s, post.word, weight FROM starts JOIN post USING (tid)
    JOIN occ ON occ.r = starts.r AND occ.word = post.word AND pos BETWEEN s + q - play AND s + q + play) x GROUP BY ALL),
kept AS (SELECT r, tid, s, f / total AS share FROM found JOIN total USING (tid) WHERE f * 10 >= total * {SHARE}),
lacking AS (
  SELECT r, tid, s FROM kept JOIN keys USING (tid) JOIN d USING (r)
  WHERE len(list_filter(range(-play, play + 1), lambda x: s + q + x >= 0 AND w[s + q + x + 1:s + q + x + len(p)] = p)) = 0),
hit AS (SELECT kept.*, label, base FROM kept ANTI JOIN lacking USING (r, tid, s) JOIN tpl USING (tid)),
per AS (
  SELECT r, count(*) FILTER (WHERE base) AS n, min(s) FILTER (WHERE base) AS a, max(s) FILTER (WHERE base) AS b,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         greatest(coalesce(max(share) FILTER (WHERE NOT base), 0), CASE WHEN bool_or(base) THEN 0.5 ELSE 0 END) AS score
  FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word,
       CAST(b AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       round(CAST(coalesce(score, 0) AS DOUBLE), 6) AS score
FROM d LEFT JOIN per USING (r)"""
