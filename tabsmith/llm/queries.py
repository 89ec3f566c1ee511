"""The registered queries of this subpackage, with SQL where it can express them."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from tabsmith.llm import centroids, embeddings, manifest, merkle, mixing, ngram_join, pieces, sharding, templates, token_counts, token_files
from tabsmith.llm import toxicity, transcripts
from tabsmith.queries.registry import query
from tabsmith.session import scratch_path


@functools.cache
def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_token_files")
def token_files_query(t):
    path = scratch_path(t.spark, "token-files")
    token_files.write_ids(t.documents, path, tokenizer_file("word_bpe_49k.json"))
    return token_files.read_ids(t.spark, path, digests_only=True)


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0::DOUBLE, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS rk FROM per),
levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(weight) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
common AS (SELECT min_by(level, rk) AS level FROM levels WHERE level * weight <= most),
target AS (
  SELECT source, source_size, least(most, coalesce(common.level * weight, most)) AS target FROM levels, common),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, doc_id, size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2.0::DOUBLE AS middle
  FROM sized s JOIN target t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(size * ((middle < target)::INT + (middle + source_size < target)::INT) AS BIGINT) AS taken
FROM placed
"""


@query("op2_mix_sources", MIX_SQL)
def mix_sources(t):
    rows = mixing.plan(t.documents)
    taken = (F.col("size") * F.size("positions")).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def _tree_sql(text: str) -> str:
    """The root of a text's tree as a DuckDB expression."""
    pieces = f"string_split({text}, chr(10))"
    marked = (
        f"array_to_string(list_transform(range(1, len({pieces}) + 1), lambda i: "
        f"sha256({pieces}[i] || CASE WHEN i < len({pieces}) THEN chr(10) ELSE '' END) || "
        f"CASE WHEN sha256({pieces}[i] || CASE WHEN i < len({pieces}) THEN chr(10) ELSE '' END)[64] IN ('0', '8') "
        f"OR trim(translate({pieces}[i], chr(13) || chr(9), '  ')) = '' THEN ';' ELSE ',' END), '')"
    )
    return (
        f"sha256(array_to_string(list_transform(string_split(regexp_replace({marked}, '[;,]$', ''), ';'), "
        f"lambda s: sha256(s)), ''))"
    )


def _phrases_sql(text: str) -> str:
    return (
        rf"list_distinct(list_append(regexp_extract_all({text}, '[^.,;:!?|\n]*[.,;:!?|\n]'), "
        rf"regexp_extract({text}, '[^.,;:!?|\n]*$')))"
    )


MERKLE_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (
  SELECT doc_id, text,
         coalesce(lead(text) OVER (ORDER BY doc_id NULLS LAST, text),
                  first_value(text) OVER (ORDER BY doc_id NULLS LAST, text)) AS nxt,
         length(text) AS n
  FROM texts),
edits AS (
  SELECT *, substring(text, 1, n - n // 4) || substring(nxt, 1, n // 4) AS edited FROM pairs),
trees AS (
  SELECT *, {_tree_sql("text")} AS fingerprint, {_tree_sql("edited")} AS edited_fingerprint,
         {_phrases_sql("text")} AS a, {_phrases_sql("edited")} AS b, {_phrases_sql("nxt")} AS c
  FROM edits)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN text = edited THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) END AS near_edited,
       CASE WHEN text = nxt THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect(a, c)) / (len(a) + len(c)) END AS near_next
FROM trees
"""


@query("op3_fingerprints", MERKLE_SQL)
def fingerprints(t):
    return merkle.fingerprints(t.documents)


@query("op7_shards")
def shards(t):
    return sharding.shard(t.documents)


TEMPLATE_SQL = """
WITH RECURSIVE raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents),
bare AS (SELECT doc_id, text, n, regexp_replace(trim(l), '[0-9]+', '0', 'g') AS line FROM raw),
lines AS (
  SELECT *, string_split(line, ' ') AS tk, len(string_split(line, ' ')) AS tokens,
         array_to_string(string_split(line, ' ')[1:3], ' ') AS head
  FROM bare WHERE line <> ''),
kinds AS (
  SELECT tokens, head, line, any_value(tk) AS tk, count(DISTINCT text) AS texts FROM lines GROUP BY ALL),
walk(tokens, head, line, tk, texts, template) AS (
  SELECT tokens, head, line, tk, texts, NULL::VARCHAR FROM kinds
  UNION ALL
  SELECT tokens, head, line, tk, texts,
         CASE WHEN len(list_filter(list_zip(tk, string_split(seed, ' ')), lambda z: z[1] = z[2])) / tokens::DOUBLE >= 0.75 THEN seed END
  FROM (SELECT *, (max({'t': texts, 'l': line}) OVER (PARTITION BY tokens, head)).l AS seed FROM walk WHERE template IS NULL)),
named AS (
  SELECT l.doc_id, l.text, l.n, l.tokens, l.head, l.line, w.template
  FROM lines l JOIN walk w USING (tokens, head, line) WHERE w.template IS NOT NULL),
found AS (
  SELECT tokens, head, template, min({'d': doc_id, 't': text}).t AS first_text
  FROM named GROUP BY ALL
  HAVING count(DISTINCT text) >= CASE WHEN tokens >= 5 OR max(length(line)) >= 40 THEN 2 ELSE 10 END),
gone AS (
  SELECT DISTINCT doc_id, n FROM named JOIN found USING (tokens, head, template) WHERE text <> first_text),
kept AS (
  SELECT r.doc_id, count(g.n) AS n_dropped, count(*) AS n_lines,
         string_agg(r.l, chr(10) ORDER BY r.n) FILTER (WHERE g.n IS NULL) AS t
  FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.n = g.n GROUP BY r.doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(coalesce(t, '')) AS kept_sha256 FROM kept
"""


@query("op10_line_templates", TEMPLATE_SQL)
def line_templates(t):
    rows = templates.drop_lines(t.documents.select("doc_id", "text"), counts=("n_lines", "n_dropped"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op4_sentencepiece")
def sentencepiece_digests(t):
    return pieces.piece_digests(t.documents, tokenizer_file("piece_bpe_32k.model"))


VECTOR_SQL = """
WITH RECURSIVE ok AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, v) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
comp AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON comp.u = vec_id LEFT JOIN counts ON counts.u = vec_id
"""


@query("op6_near_vectors", VECTOR_SQL)
def near_vectors(t):
    return embeddings.near_vectors(t.embeddings)


@query("op8_toxicity")
def toxicity_scores(t):
    held_out = toxicity.held_out()
    model = toxicity.train(t.documents, t.labels.filter(~held_out))
    rows = toxicity.score(t.documents, model)
    return rows.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(u, v) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.v) AS component_id
FROM sets s JOIN reach r ON r.u = s.doc_id GROUP BY s.doc_id, s.s
"""


@query("op9_ngram_join", JACCARD_SQL)
def ngram_links(t):
    return ngram_join.ngram_components(t.documents).select("doc_id", "n_shingles", "component_id")


@query("op5_chat_format")
def chat_format(t):
    turns = transcripts.format_conversations(t.conversations)
    return turns.select(
        F.col("conv").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "n_lines",
        F.sha2("rendered", 256).alias("rendered_sha256"),
    )


@query("op11_token_counts")
def token_count_rows(t):
    return token_counts.token_counts(t.documents, tokenizer_file("piece_bpe_32k.model"))


def _clusters_sql(k: int = 40, rounds: int = 5) -> str:
    """Lloyd's rounds as a chain of steps; all pairs of vector and centroid are compared."""
    near = """
a{r} AS MATERIALIZED (
  SELECT row, min_by(c, {{'d': d, 'c': c}}) AS c, min(d) AS d FROM (
    SELECT v.row, c.c, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
    FROM v CROSS JOIN c{r} c) GROUP BY row)"""
    move = """
c{n} AS MATERIALIZED (
  SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM (
      SELECT c, i, sum(e)::BIGINT AS s, count(*) AS n
      FROM (SELECT a.c, unnest(v.x) AS e, generate_subscripts(v.x, 1) AS i FROM a{r} a JOIN v USING (row)) GROUP BY c, i) GROUP BY c) m
  ON c.c = m.c)"""
    steps = "".join(near.format(r=r) + "," + move.format(r=r, n=r + 1) + "," for r in range(rounds)) + near.format(r=rounds)
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (
    SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM v ORDER BY h, x LIMIT {k})),{steps}
SELECT vec_id, a.c::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM v JOIN a{rounds} a USING (row) JOIN c{rounds} c ON a.c = c.c
"""


@query("op12_centroid_clusters", _clusters_sql())
def centroid_clusters(t):
    return centroids.clustered_vectors(t.embeddings)


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_field_sql(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE read AS (
  SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
         {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS lower_leaf,
         list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ord(s)::BIGINT), lambda a, b:
           list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(a, b)),
           4294967295) AS rest
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER () AS key, CASE WHEN xor(rest, 4294967295) % 3 = 0 THEN lower_leaf ELSE leaf END AS seen,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n
  FROM read),
nodes(lv, lang, pos, n, h) AS (
  SELECT 0, lang, r, n, leaf FROM leaves
  UNION ALL
  SELECT lv + 1, lang, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY lv, lang, pos // 8, n),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS r, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(lv, pos, n, h) AS (
  SELECT 0, r, n, h FROM subroots
  UNION ALL
  SELECT lv + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY lv, pos // 8, n),
steps AS (
  SELECT l.key, 0 AS tree, a.lv, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM leaves l JOIN nodes a ON l.lang IS NOT DISTINCT FROM a.lang AND l.r // (1 << (3 * a.lv)) = a.pos AND a.n > 1
  JOIN nodes b ON b.lang IS NOT DISTINCT FROM a.lang AND b.lv = a.lv AND b.pos // 8 = a.pos // 8
  GROUP BY l.key, a.lv
  UNION ALL
  SELECT l.key, 1, a.lv, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''),
         coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN tops a ON s.r // (1 << (3 * a.lv)) = a.pos AND a.n > 1
  JOIN tops b ON b.lv = a.lv AND b.pos // 8 = a.pos // 8
  GROUP BY l.key, a.lv),
paths AS (SELECT key, list({{'before': before, 'after': after}} ORDER BY tree, lv) AS p FROM steps GROUP BY key),
done AS (
  SELECT l.doc_id, l.leaf, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, coalesce(p, []) AS p,
         list_reduce(coalesce(p, []), lambda a, x: {{'before': sha256(x.before || a.before || x.after), 'after': ''}},
                     {{'before': l.seen, 'after': ''}}).before AS folded_root
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths USING (key))
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(p, lambda x: x.before || x.after), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM done
"""


@query("op13_dataset_manifest", MANIFEST_SQL)
def dataset_manifest(t):
    return manifest.tampered_proofs(t.documents)
