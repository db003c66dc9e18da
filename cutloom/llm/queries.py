"""The thin ``opN_*`` queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutloom.llm import audit, bpe, centroids, credentials, embdedup, langid, licenses, lines, ngramjoin, packing, passages, pii, topk
from cutloom.llm.common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary("byte_bpe_50k.json"), decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[_count("base", k).alias(f"n_{k}") for k in pii.PATTERNS],
        F.sha2(pii.listed("base"), 256).alias("base_sha256"),
        pii.listed("spans").alias("spans"),
        _count("spans", "secret").alias("n_secret"),
        _count("spans", "term").alias("n_term"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH x AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM x q JOIN x c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    profiles = langid.fit(docs.filter(~held_out))
    found = langid.predict(docs.select("doc_id", "text"), profiles)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP7_SQL = """
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
a AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM d),
b AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13)) <> '' AS filled FROM a),
c AS (SELECT doc_id, line, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM b WHERE filled),
p AS (
  SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY n) AS line2,
    length(trim(line)) - length(replace(trim(line), ' ', '')) >= 3 AS alone FROM c
),
q AS (
  SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, n) > 1 AS again,
    line2 IS NOT NULL AND row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, n) > 1 AS again2 FROM p
),
g AS (SELECT *, (again AND alone) OR again2 OR coalesce(lag(again2) OVER (PARTITION BY doc_id ORDER BY n), false) AS gone FROM q),
h AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY n), false) AS begins FROM g),
s AS (
  SELECT doc_id, count(*) AS n_lines, count_if(gone) AS n_removed, count_if(begins) AS n_runs, list(i) FILTER (WHERE gone) AS cut FROM h GROUP BY doc_id
),
t AS (
  SELECT b.doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM b JOIN s ON b.doc_id = s.doc_id
  WHERE cut IS NOT NULL AND NOT list_contains(cut, i) GROUP BY b.doc_id
)
SELECT d.doc_id, CASE WHEN cut IS NULL THEN d.text WHEN n_removed = n_lines THEN '' ELSE t.text END AS text,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_runs, 0) AS n_runs
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN t USING (doc_id)
"""


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


OP8_SQL = """
WITH RECURSIVE x AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS v FROM embeddings
), ok AS (
  SELECT * FROM x WHERE label IS NOT NULL AND v IS NOT NULL
    AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0
    AND len(list_filter(v, lambda c: c <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM x
  UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a
)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN n USING (vec_id)
"""


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.near_duplicates(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _licenses_sql() -> str:
    """Brute force: every window of every text against every template of its size."""
    size, need = licenses.width_of, licenses.DECIDING
    templates = ", ".join(f"('{label}', {size(t)}, {sorted(set(t.split()))}, {need.get(label, '')!r})" for label, t in licenses.TEMPLATES.items())
    phrases = ", ".join(f"({p.split()}, '{label}')" for p, label in licenses.PHRASES.items())
    lower = f"translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}')"
    words = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"
    return f"""
WITH t(label, width, words, need) AS (VALUES {templates}), p(words, label) AS (VALUES {phrases}),
d AS (SELECT doc_id, row_number() OVER () AS k, {lower} AS text FROM documents),
w AS (SELECT doc_id, k, {words.format("text")} AS words FROM d),
b AS (
  SELECT k, label, i FROM (SELECT k, words AS dw, unnest(range(len(words))) AS i FROM w), p
  WHERE dw[i + 1] = p.words[1] AND dw[i + 1 : i + len(p.words)] = p.words
),
bb AS (
  SELECT k, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM b GROUP BY k
),
s AS (
  SELECT k, words, width, unnest(range(greatest(0, len(words) - width - 1) // width + 1)) AS i
  FROM w, (SELECT DISTINCT width FROM t)
),
l AS (SELECT k, width, i, words[i * width + 1 : (i + 2) * width] AS words FROM s),
m AS (
  SELECT l.k, l.width, l.i, t.label, t.words AS tw, list_intersect(t.words, l.words) AS met, len(list_intersect(t.words, l.words)) / len(t.words) AS part FROM l JOIN t USING (width)
  WHERE (need = '' OR list_contains(l.words, need)) AND len(list_intersect(t.words, l.words)) >= 0.8 * len(t.words) - 1e-9
),
o AS (SELECT m.*, EXISTS (SELECT 1 FROM m y WHERE y.k = m.k AND y.width = m.width AND y.i = m.i AND list_has_all(y.tw, m.met) 
  AND (len(y.tw) > len(m.tw) OR (len(y.tw) = len(m.tw) AND (y.part > m.part OR (y.part = m.part AND y.label < m.label))))) AS inside FROM m),
n AS (SELECT k, list(DISTINCT label) FILTER (WHERE NOT inside) AS labels, max(part) AS part FROM o GROUP BY k)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(bb.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(bb.labels, n.labels))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0) END AS score
FROM w LEFT JOIN bb USING (k) LEFT JOIN n USING (k)
"""


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda spans, kind: F.size(F.filter(spans, lambda s: s["rank"] == credentials.RANK[kind])).cast("long")
    return found.select(
        "doc_id",
        *[of("base", k).alias(f"n_{k}") for k in credentials.BASE],
        F.sha2(credentials.listed("base"), 256).alias("base_sha256"),
        credentials.listed("spans").alias("spans"),
        F.size("links").cast("long").alias("n_linked"),
    )


def _secrets_sql(reach: int = 200) -> str:
    """Every pair of parts of a paragraph, compared by their places."""
    c = credentials
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def matches(kind: str) -> str:
        p, g = quoted(c.PATTERNS[kind]), 2 if "(" in c.PATTERNS[kind] else 0
        valid = "length(value) >= {}".format(c.LEAST[kind])
        if kind == "run":
            valid += f" AND len(list_distinct(string_split(value, ''))) >= {c.DIFFERENT} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')"
        return f"""
  SELECT k, {c.RANK[kind]} AS rank, pos AS a, pos + length(hit) AS b FROM (
    SELECT k, hit, value, sum(length(gap)) OVER w + coalesce(sum(length(hit)) OVER v, 0) AS pos FROM (
      SELECT k, unnest(regexp_split_to_array(t, {p})) AS gap, unnest(regexp_extract_all(t, {p})) AS hit,
        unnest(regexp_extract_all(t, {p}, {g})) AS value, unnest(range(len(regexp_extract_all(t, {p})) + 1)) AS i
      FROM d WHERE regexp_matches(t, {p})
    )
    WINDOW w AS (PARTITION BY k ORDER BY i), v AS (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  ) WHERE hit IS NOT NULL AND {valid}"""

    union = lambda kinds: " UNION ALL ".join(map(matches, kinds))
    ranks = lambda kinds: "(" + ", ".join(str(c.RANK[k]) for k in kinds) + ")"
    rules = " OR ".join(f"(w.rank = {c.RANK[k]} AND p.rank IN {ranks({x for g in gs for x in c.GROUPS[g]})})" for k, gs in c.COMPLEMENT.items())
    names = "[" + ", ".join(f"'{k}'" for k in c.PATTERNS) + "]"
    said = lambda x: f"coalesce(string_agg({names}[{x}.rank + 1] || ':' || {x}.a || ':' || {x}.b, ',' ORDER BY {x}.a, {x}.rank, {x}.b), '')"
    overlap = lambda t, s: f"NOT EXISTS (SELECT 1 FROM {t} o WHERE o.k = {s}.k AND o.a < {s}.b AND {s}.a < o.b)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
base AS ({union(c.BASE)}),
named AS (SELECT * FROM ({union(("account", "pass", "host"))}) n WHERE {overlap("base", "n")}
  UNION ALL {matches("url")}),
others AS (SELECT * FROM base UNION ALL SELECT * FROM named),
weak AS (SELECT * FROM named UNION ALL SELECT * FROM ({matches("run")}) r WHERE {overlap("others", "r")}),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
scoped AS (
  SELECT p.*, len(regexp_extract_all(substr(d.t, 1, CAST(a AS BIGINT)), '\\n[ \\t\\r]*\\n')) AS scope
  FROM parts p JOIN d USING (k)
),
linked AS (
  SELECT w.k, w.a, w.rank, w.b FROM scoped w WHERE EXISTS (
    SELECT 1 FROM scoped p WHERE p.k = w.k AND p.scope = w.scope AND (p.a, p.rank, p.b) <> (w.a, w.rank, w.b)
      AND greatest(0, p.a - w.b, w.a - p.b) <= {reach} AND ({rules})
  )
),
spans AS (SELECT k, a, rank, b FROM base UNION ALL SELECT * FROM linked),
bb AS (
  SELECT k, {", ".join(f"count(*) FILTER (WHERE rank = {c.RANK[x]}) AS n_{x}" for x in c.BASE)}, {said("base")} AS listed FROM base GROUP BY k
),
ss AS (SELECT k, {said("spans")} AS spans, count(*) FILTER (WHERE rank >= {len(c.BASE)}) AS n_linked FROM spans GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{x}, 0) AS n_{x}" for x in c.BASE)}, sha256(coalesce(listed, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN bb USING (k) LEFT JOIN ss USING (k)
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = """
WITH RECURSIVE d AS (
  SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t),
    regexp_matches(t, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)
  ] AS fails FROM d LEFT JOIN l USING (doc_id)
), o AS (
  SELECT '' AS filter_order UNION ALL
  SELECT filter_order || x FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(filter_order, x)
), s AS (
  SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE length(filter_order) = 5
), n AS (
  SELECT *, list_transform(range(1, step), lambda i: ascii(substr(filter_order, i, 1)) - 64) AS earlier, ascii(substr(filter_order, step, 1)) - 64 AS own FROM s
), g AS (
  SELECT part, fails, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f GROUP BY ALL
), m AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS bad, len(list_filter(earlier, lambda i: fails[i])) > 0 AS gone,
    len(list_filter(fails, lambda x: x)) AS many
  FROM g, n
), r AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
    sum(CASE WHEN NOT gone AND NOT bad THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND bad THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN gone AND bad THEN n ELSE 0 END) AS redundant, sum(CASE WHEN bad AND many = 1 THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN NOT gone AND bad THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND bad THEN toxic ELSE 0 END) AS toxic_lost
  FROM m GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r
"""


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Every vector against every centroid, round after round."""
    nearest = """
  SELECT i, vec_id, v, c, d FROM (
    SELECT i, vec_id, x.v, c, d, row_number() OVER (PARTITION BY i ORDER BY d, c) AS place FROM (
      SELECT x.i, x.vec_id, x.v, m.c, CAST(list_sum(list_transform(list_zip(x.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM x, {m} m
    ) x
  ) WHERE place = 1"""
    steps = []
    for r in range(1, rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(m=f'm{r - 1}')})")
        steps.append(f"""u{r} AS (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM (
    SELECT c, j, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS y, unnest(range(64)) AS j FROM a{r}) GROUP BY c, j
  ) GROUP BY c
)""")
        steps.append(f"m{r} AS MATERIALIZED (SELECT m.c, coalesce(u.v, m.v) AS v FROM m{r - 1} m LEFT JOIN u{r} u USING (c))")
    chain = ",\n".join(steps)
    return f"""
WITH x AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id,
    list_transform(embedding, lambda e: CAST(greatest(-{centroids.LIMIT}, least({centroids.LIMIT}, floor(1024 * CAST(e AS DOUBLE)))) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
),
m0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (
    SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM x WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}
  )
),
{chain},
f AS MATERIALIZED ({nearest.format(m=f"m{rounds}")})
SELECT vec_id, CAST(f.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256
FROM f JOIN m{rounds} m ON f.c = m.c
"""


QUERIES = {
    "op1_pii": op1_pii,
    "op2_topk": op2_topk,
    "op3_packing": op3_packing,
    "op4_langid": op4_langid,
    "op5_bpe": op5_bpe,
    "op6_passages": op6_passages,
    "op7_line_dedup": op7_line_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_ngram_join": op9_ngram_join,
    "op10_licenses": op10_licenses,
    "op11_secrets": op11_secrets,
    "op12_filter_audit": op12_filter_audit,
    "op13_clusters": op13_clusters,
}
ORACLE_SQL: dict[str, str] = {"op2_topk": OP2_SQL, "op7_line_dedup": OP7_SQL, "op8_embedding_dedup": OP8_SQL, "op10_licenses": _licenses_sql(), "op11_secrets": _secrets_sql(), "op12_filter_audit": OP12_SQL, "op13_clusters": _clusters_sql()}
