"""SQL of queries whose operators are folds: a recursive query takes one row of every group at a step."""

from __future__ import annotations

from cutloom.plans.registry import ORACLE_SQL
from cutloom.sources import derived


def stated(name: str, sql: str) -> None:
    ORACLE_SQL[name] = derived.SQL + sql


stated("w23_text_batches", """, tb AS (SELECT media_id, seg_id, length(text) AS n, row_number() OVER (PARTITION BY media_id ORDER BY seg_id) AS k FROM segments)
SELECT * FROM (WITH RECURSIVE b AS (
  SELECT media_id, seg_id, k, 0 AS batch, n + 12 AS size FROM tb WHERE k = 1
  UNION ALL SELECT t.media_id, t.seg_id, t.k, batch + (size + n > 800)::INT, CASE WHEN size + n > 800 THEN n + 12 ELSE size + n + 12 END FROM b JOIN tb t ON t.media_id = b.media_id AND t.k = b.k + 1
) SELECT media_id, seg_id, CAST(batch AS BIGINT) AS batch FROM b)""")  # fmt: skip

stated("w26_without_overlaps", """, wo AS (SELECT media_id, s_ms, e_ms, w, row_number() OVER (PARTITION BY media_id ORDER BY s_ms, e_ms) AS k FROM (SELECT media_id, s_ms, e_ms + pos % 5 * 60 AS e_ms, w FROM words))
SELECT * FROM (WITH RECURSIVE o AS (
  SELECT *, e_ms AS reach, true AS kept FROM wo WHERE k = 1
  UNION ALL SELECT n.media_id, n.s_ms, n.e_ms, n.w, n.k, CASE WHEN n.s_ms >= reach - 50 THEN greatest(reach, n.e_ms) ELSE reach END, n.s_ms >= reach - 50 FROM o JOIN wo n ON n.media_id = o.media_id AND n.k = o.k + 1
) SELECT media_id, s_ms, e_ms, w FROM o WHERE kept)""")  # fmt: skip

stated("k03_spread_teasers", """, kc AS (SELECT media_id AS plan_id, seg_id AS cand_no, seg_id AS a, seg_id + n_words % 3 AS b, row_number() OVER (PARTITION BY media_id ORDER BY n_words % 17 DESC, seg_id) AS k FROM segments)
SELECT * FROM (WITH RECURSIVE g AS (
  SELECT plan_id, cand_no, k, [{'a': a, 'b': b}] AS taken, true AS in_ FROM kc WHERE k = 1
  UNION ALL SELECT plan_id, cand_no, k, CASE WHEN free THEN list_append(taken, {'a': a, 'b': b}) ELSE taken END, free FROM (
    SELECT n.*, g.taken, len(g.taken) < 4 AND len(list_filter(g.taken, lambda t: NOT (n.b < t.a OR n.a > t.b))) = 0 AS free FROM g JOIN kc n ON n.plan_id = g.plan_id AND n.k = g.k + 1)
) SELECT plan_id, cand_no, CAST(len(taken) AS BIGINT) AS place FROM g WHERE in_)""")  # fmt: skip

stated("k07_assigned_shots", """, ks AS (SELECT media_id AS job_id, seg_id AS ord, CAST(greatest(1, least(4, round_even((end_ms - start_ms) / 5000.0::DOUBLE, 0))) AS BIGINT) AS want, list_transform([0, 1, 2, 3], lambda r: (seg_id * 3 + r * 5) % 7) AS shots FROM segments),
kp AS (SELECT job_id, ord, shots, unnest(range(1, want + 1)) AS place FROM ks), kn AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord, place) AS k FROM kp)
SELECT * FROM (WITH RECURSIVE u AS (
  SELECT job_id, ord, place, k, shots[1] AS shot, [shots[1]] AS used FROM kn WHERE k = 1
  UNION ALL SELECT job_id, ord, place, k, pick, list_append(used, pick) FROM (
    SELECT n.*, u.used, list_min(list_transform(range(1, 5), lambda i: {'out': (n.shots[i] = u.shot)::INT, 'n': len(list_filter(u.used, lambda x: x = n.shots[i])), 'i': i, 's': n.shots[i]})).s AS pick
    FROM u JOIN kn n ON n.job_id = u.job_id AND n.k = u.k + 1)
) SELECT job_id, ord, place, shot FROM u)""")  # fmt: skip

stated("w10_loudest_microphone", """, lv AS (SELECT media_id, s_ms, list({'r': -(100.0::DOUBLE + (pos * 31 + m * 47) % 90), 'm': 'mic' || m} ORDER BY -(100.0::DOUBLE + (pos * 31 + m * 47) % 90), 'mic' || m) AS l FROM words, range(3) x(m) GROUP BY media_id, s_ms),
lt AS (SELECT media_id, s_ms, l[1].m AS mic, l[1].r / l[2].r < 1.3 AS unsure, row_number() OVER (PARTITION BY media_id ORDER BY s_ms) AS k FROM lv)
SELECT * FROM (WITH RECURSIVE h AS (
  SELECT media_id, s_ms, k, mic AS spk FROM lt WHERE k = 1
  UNION ALL SELECT n.media_id, n.s_ms, n.k, CASE WHEN n.unsure THEN h.spk ELSE n.mic END FROM h JOIN lt n ON n.media_id = h.media_id AND n.k = h.k + 1
) SELECT media_id, s_ms, spk FROM h)""")  # fmt: skip

stated("w07_group_words", r""", gw AS (SELECT media_id, w, s_ms, e_ms, spk, row_number() OVER (PARTITION BY media_id ORDER BY s_ms, e_ms) AS k FROM words)
SELECT * FROM (WITH RECURSIVE g AS (
  SELECT *, s_ms AS first, 1 AS seg FROM gw WHERE k = 1
  UNION ALL SELECT media_id, w, s_ms, e_ms, spk, k, CASE WHEN new THEN s_ms ELSE first END, seg + new::INT FROM (
    SELECT n.*, g.first, g.seg, n.s_ms - g.e_ms > 900 OR n.e_ms - g.first > 20000 OR n.spk <> g.spk OR (regexp_matches(g.w, '[.!?…]$') AND g.e_ms - g.first >= 1200) AS new FROM g JOIN gw n ON n.media_id = g.media_id AND n.k = g.k + 1)
) SELECT media_id, CAST(seg AS BIGINT) AS seg_id, min(s_ms) AS start_ms, arg_max(e_ms, k) AS end_ms, trim(regexp_replace(string_agg(w, ' ' ORDER BY k), '\s+([,.;:!?…])', '\1', 'g')) AS text, arg_min(spk, k) AS speaker, count(*) AS n_words FROM g GROUP BY media_id, seg)""")  # fmt: skip

stated("w11_voice_chunks", """, vw AS (SELECT media_id, seg_id, s_ms, e_ms, row_number() OVER (PARTITION BY media_id, seg_id ORDER BY s_ms, e_ms) AS k FROM words)
SELECT * FROM (WITH RECURSIVE v AS (
  SELECT *, s_ms AS a, 1 AS c FROM vw WHERE k = 1
  UNION ALL SELECT n.media_id, n.seg_id, n.s_ms, n.e_ms, n.k, CASE WHEN v.e_ms - v.a >= 2500 THEN n.s_ms ELSE v.a END, c + (v.e_ms - v.a >= 2500)::INT FROM v JOIN vw n ON n.media_id = v.media_id AND n.seg_id = v.seg_id AND n.k = v.k + 1
), ch AS (SELECT media_id, seg_id, c, min(a) AS a, arg_max(e_ms, k) AS b FROM v GROUP BY ALL),
sh AS (SELECT *, c > 1 AND c = max(c) OVER (PARTITION BY media_id, seg_id) AND b - a < 600 AS tail FROM ch), ex AS (SELECT *, lead(tail) OVER w AS t, lead(b) OVER w AS nb FROM sh WINDOW w AS (PARTITION BY media_id, seg_id ORDER BY c))
SELECT media_id, seg_id, CAST(c AS BIGINT) AS chunk_no, a AS start_ms, CASE WHEN t THEN nb ELSE b END AS end_ms FROM ex WHERE NOT tail)""")  # fmt: skip

stated("v04_picture_cuts", """, vc AS (SELECT seq_id, clip_ix, c.start_ms + t_ms - in_ms AS at_ms FROM cuts k JOIN clips c ON k.media_id = c.media_id AND t_ms BETWEEN in_ms AND out_ms
  WHERE kind = 'video' AND NOT disabled AND c.end_ms - c.start_ms >= 800 AND t_ms - in_ms BETWEEN 120 AND c.end_ms - c.start_ms - 120),
vk AS (SELECT seq_id, at_ms, row_number() OVER (PARTITION BY seq_id ORDER BY clip_ix, at_ms) AS k FROM vc)
SELECT * FROM (WITH RECURSIVE f AS (
  SELECT seq_id, k, at_ms, true AS in_, [at_ms] AS kept FROM vk WHERE k = 1
  UNION ALL SELECT seq_id, k, at_ms, free, CASE WHEN free THEN list_append(kept, at_ms) ELSE kept END FROM (
    SELECT n.*, f.kept, len(list_filter(f.kept, lambda y: abs(y - n.at_ms) < 200)) = 0 AS free FROM f JOIN vk n ON n.seq_id = f.seq_id AND n.k = f.k + 1)
) SELECT seq_id, at_ms FROM f WHERE in_)""")  # fmt: skip
