"""SQL that states the results of ``queries`` where SQL can."""

from __future__ import annotations

_P2 = """
WITH ranked AS (
  SELECT instances, row_number() OVER (PARTITION BY image_id ORDER BY updated_at DESC NULLS LAST, row_id DESC) AS k
  FROM processed_records WHERE image_id IS NOT NULL),
inst AS (SELECT unnest(instances) AS i FROM ranked WHERE k = 1),
cat AS (
  SELECT coalesce(nullif(lower(regexp_replace(i.attr_id, '^\\s+|\\s+$', '', 'g')), ''), m.attr_id) AS attr_id
  FROM inst LEFT JOIN class_map m ON m.class_id = i.class_id WHERE i IS NOT NULL),
counts AS (SELECT attr_id, count(*) AS available FROM cat WHERE attr_id IS NOT NULL GROUP BY 1),
total AS (SELECT coalesce(sum(available), 0) AS n FROM counts),
report AS (
  SELECT t.plan_id, t.attr_id, coalesce(c.available, 0) AS available,
    greatest(t.min_count, ((SELECT n FROM total)::HUGEINT * t.sample_permille * t.target_permille + 999999) // 1000000)::BIGINT AS want
  FROM sample_targets t LEFT JOIN counts c USING (attr_id))
"""

_P4 = """
WITH ranked AS (
  SELECT images.image_id AS image_id, lower(trim(images.split)) AS split, source, phash,
    nullif(regexp_extract(lower(trim(sha256)), '^(?:sha256:)?([0-9a-f]{64})$', 1), '') AS sha,
    row_number() OVER (PARTITION BY images.image_id ORDER BY scanned_at DESC) AS k
  FROM same_release_split_leakage_audit WHERE images.image_id IS NOT NULL),
img AS (SELECT * FROM ranked WHERE k = 1 AND split IS NOT NULL),
pairs AS (
  SELECT a.image_id AS train_id, b.image_id AS image_id, b.split, trim(b.source) AS source, coalesce(a.sha = b.sha, false) AS same_content
  FROM img a JOIN img b ON a.split = 'train2017' AND b.split IN ('val2017', 'test2017')
    AND (a.sha = b.sha OR bit_count(xor(a.phash, b.phash)) <= 5))
"""

_P8 = r"""
WITH docs AS (
  SELECT lower(trim(source)) AS source,
    len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) AS tokens
  FROM documents),
per AS (SELECT source, sum(tokens) AS tokens FROM docs GROUP BY 1),
total AS (SELECT sum(tokens) AS n FROM docs),
w AS (SELECT m.mix_id, m.source, (SELECT n FROM total) * m.budget_permille * m.target_permille AS micro, m.max_repeats * coalesce(p.tokens, 0) * 1000000 AS most
  FROM mix_targets m LEFT JOIN per p ON p.source = lower(trim(m.source)))
"""

_P1 = r"""
WITH RECURSIVE r AS (
  SELECT record_id, min(CASE lower(trim(source_split)) WHEN 'valid' THEN 'val' ELSE nullif(lower(trim(source_split)), '') END) AS split, max(CASE WHEN k NOT IN ('', 'unknown', 'none', 'n-a') THEN 'v:' || k END) AS v,
    max(CASE WHEN dataset_id IS NOT NULL AND group_id IS NOT NULL THEN 'g:' || dataset_id || '|' || group_id END) AS g
  FROM (SELECT *, trim(regexp_replace(lower(source_video_group), '[^a-z0-9]+', '-', 'g'), '-') AS k FROM audit_yolo_detection_dataset) WHERE record_id IS NOT NULL GROUP BY 1),
e AS (SELECT DISTINCT v AS a, g AS b FROM r WHERE v IS NOT NULL AND g IS NOT NULL),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(x, y) AS (SELECT a, b FROM b UNION SELECT reach.x, b.b FROM reach JOIN b ON b.a = reach.y),
root AS (SELECT x, least(x, min(y)) AS root FROM reach GROUP BY x),
c AS (SELECT record_id, split, coalesce(root, v, g, 'r:' || record_id) AS comp FROM r LEFT JOIN root ON x = coalesce(v, g))
SELECT record_id FROM c WHERE comp IN (SELECT comp FROM c GROUP BY 1 HAVING count(DISTINCT split) > 1)
"""

_P3 = """
WITH RECURSIVE r AS (
  SELECT record_id, max(phash) AS phash, max(CASE WHEN dataset_id IS NOT NULL AND group_id IS NOT NULL THEN dataset_id || '|' || group_id END) AS hub
  FROM audit_yolo_detection_dataset WHERE record_id IS NOT NULL GROUP BY 1),
e AS (
  SELECT record_id AS u, min(record_id) OVER (PARTITION BY hub) AS v FROM r WHERE hub IS NOT NULL
  UNION SELECT m.left_record_id, m.right_record_id FROM phash_matches m JOIN r a ON a.record_id = m.left_record_id JOIN r b ON b.record_id = m.right_record_id
  WHERE m.match_kind = 'sha256' OR (m.match_kind = 'phash' AND coalesce(m.phash_distance, bit_count(xor(a.phash, b.phash))) <= 2)),
b AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
reach(x, y) AS (SELECT u, v FROM b UNION SELECT reach.x, b.v FROM reach JOIN b ON b.u = reach.y),
g AS (SELECT least(x, min(y)) AS group_root, x AS record_id FROM reach GROUP BY x),
a AS (SELECT coalesce(group_root, record_id) AS group_root, record_id FROM r LEFT JOIN g USING (record_id))
"""

ORACLES: dict[str, str] = {
    "p1_found": _P1,
    "p3_found": _P3 + "SELECT * FROM g",
    "p3_groups": _P3 + "SELECT group_root, record_id, count(*) OVER (PARTITION BY group_root) AS group_size FROM a",
    "p2_found": _P2 + "SELECT plan_id, attr_id FROM report WHERE available < want",
    "p2_report": _P2 + "SELECT plan_id, attr_id, available, want, least(available, want) AS taken, available < want AS short FROM report",
    "p4_found": _P4 + "SELECT DISTINCT least(train_id, image_id) AS left_image_id, greatest(train_id, image_id) AS right_image_id FROM pairs",
    "p4_report": _P4
    + """SELECT split, source, count(DISTINCT image_id) AS images, count(*) AS pairs, count(*) FILTER (same_content) AS same_content_pairs
         FROM pairs GROUP BY split, source""",
    "p8_found": _P8 + "SELECT mix_id, source FROM w WHERE most < micro",
    "p8_targets": _P8 + "SELECT mix_id, source, round(micro / 1000000)::BIGINT AS want_tokens, most < micro AS short, most >= micro AS met FROM w",
}
