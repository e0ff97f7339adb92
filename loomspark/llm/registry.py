"""Queries of the operators over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import line_quality as lq
from loomspark.llm import token_counts as tc
from loomspark.llm.decontamination import find_leaks
from loomspark.llm.fill_in_middle import fill_in_middle, restored
from loomspark.llm.licenses import PHRASES, STRETCH, TEMPLATES, scan_licenses
from loomspark.llm.merkle import verified_documents
from loomspark.llm.mixing import mix, mixture_by_document
from loomspark.llm.near_duplicates import near_duplicates
from loomspark.llm.quality_trees import quality
from loomspark.llm.repeated_passages import remove_repeated_passages
from loomspark.llm.simhash import simhash_duplicates
from loomspark.llm.toxicity import toxicity
from loomspark.llm.url_filter import filter_urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_by_document(_table(spark, sf_dir, "documents")).drop("source")


def op1_mixing_dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))[0]


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=5, fold=0)
    return scored.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").cast("long").alias("n_offending"), F.try_element_at("offending", F.lit(1))["sentence"].alias("first_offending"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents")).drop("spans")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), k=2, percent=80)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(_table(spark, sf_dir, "documents"), length=50).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lq.line_quality(docs, lq.fit_lines(docs, _table(spark, sf_dir, "labels")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Fixed values: (host, path, verdict).
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in URL_RULES])
    rules = spark.range(1).select(F.inline(rows))
    return filter_urls(_table(spark, sf_dir, "pages"), rules).drop("n_open")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), folds=3, fold=1)
    return scored.select("doc_id", "held_out", "score", "predicted")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    automaton = tc.build(tc.read_vocabulary(tc.DEFAULT_VOCABULARY))
    return tc.token_counts(_table(spark, sf_dir, "documents"), automaton)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_documents(_table(spark, sf_dir, "documents"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(_table(spark, sf_dir, "documents"), k=3, radius=2).drop("kept")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(_table(spark, sf_dir, "documents"), seed=1)
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op1_mixing_dealt": op1_mixing_dealt,
    "op2_toxicity": op2_toxicity,
    "op3_license_scan": op3_license_scan,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_decontamination": op7_decontamination,
    "op8_url_filter": op8_url_filter,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_token_counts": op10_token_counts,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}

#: op5: every window of 50 words by its text. It holds all windows at once and is meant for small tables.
_OP5_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS t FROM w, unnest(generate_series(1, len(ws) - 49)) AS g(i) WHERE len(ws) >= 50),
hit AS (SELECT doc_id, list(i) AS hits FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS m FROM win) WHERE doc_id > m GROUP BY doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM hit, unnest(hits) AS h(i), unnest(generate_series(i, i + 49)) AS q(p) GROUP BY doc_id),
pos AS (SELECT w.doc_id, p, ws[p] AS word FROM w, unnest(generate_series(1, len(ws))) AS g(p)),
dead AS (SELECT doc_id, unnest(ps) AS p FROM gone),
kept AS (SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) AS t, count(*) AS n FROM pos ANTI JOIN dead ON pos.doc_id = dead.doc_id AND pos.p = dead.p GROUP BY pos.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""

#: op1: the targets, the permutation, the tree (a recursion over its nodes and their sources), and the shuffled shards.
_OP1_SQL = r"""
WITH RECURSIVE s AS (SELECT doc_id, source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS size FROM documents GROUP BY doc_id, source),
src AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS no FROM s GROUP BY source),
w AS (SELECT *, CASE (no - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2 * source_size AS cap FROM src),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, no) AS r, sum(source_size) OVER () AS total FROM w),
b AS (SELECT *, (1.5::DOUBLE * total::DOUBLE - coalesce(sum(cap) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) / (sum(weight) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS rate FROM o),
lv AS (SELECT min_by(rate, r) AS level FROM b WHERE weight * rate <= cap),
t AS (SELECT source, no, source_size, CASE WHEN level IS NULL OR weight * level > cap THEN cap::DOUBLE ELSE weight * level END AS target FROM b, lv),
g AS (SELECT *, round_even(target, 0)::BIGINT AS goal FROM t),
e AS (SELECT *, CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END AS epochs, goal - CASE WHEN source_size > 0 THEN goal // source_size ELSE 0 END * source_size AS extra FROM g),
d AS (SELECT s.doc_id, s.source, s.size, e.* EXCLUDE (source) FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source),
blk AS (SELECT doc_id, source, no, epochs, extra, i AS block, least(256, size - i * 256) AS n, md5('mix:' || doc_id::VARCHAR || ':' || i::VARCHAR) AS k FROM d, unnest(generate_series(0, (size - 1) // 256)) AS x(i) WHERE size > 0),
c AS (SELECT *, extra - sum(n) OVER (PARTITION BY no ORDER BY k, doc_id, block ROWS UNBOUNDED PRECEDING) + n AS rest,
      row_number() OVER (PARTITION BY no ORDER BY k, doc_id, block) - 1 AS rank, count(*) OVER (PARTITION BY no) AS n_blocks FROM blk),
m AS (SELECT *, greatest(0, least(n, rest))::BIGINT AS more, epochs + (rest > 0)::BIGINT AS passes FROM c WHERE epochs > 0 OR rest > 0),
qu AS (SELECT no, sum(passes)::BIGINT AS quota FROM m GROUP BY no),
top AS (SELECT list(no ORDER BY no) AS nos, list(quota ORDER BY no) AS q, sum(quota)::BIGINT AS total, greatest(4, ceil(log2(greatest(1, sum(quota) / 65536))))::BIGINT AS levels FROM qu),
tree(level, node, i, rest, room, q, taken) AS (
  SELECT 0::BIGINT, 1::BIGINT, 1::BIGINT, total, total // 2, q, []::BIGINT[] FROM top WHERE total > 0
  UNION ALL
  SELECT level + up, unnest(node_next), i_next, unnest(rest_next), unnest(room_next), unnest(q_next), taken_next FROM (
    SELECT level, 0 AS up, [node] AS node_next, i + 1 AS i_next, [rest - own] AS rest_next, [room - x] AS room_next, [q] AS q_next, list_append(taken, x) AS taken_next FROM (
      SELECT *, least(hi, lo + list_reduce(w, lambda a, p: {'s': a.s + p, 'n': a.n + (a.s + p < u * list_sum(w))::BIGINT}, {'s': 0.0::DOUBLE, 'n': 0::BIGINT}).n) AS x FROM (
        SELECT *, list_transform(range(lo, hi + 1), lambda x: exp(lgamma(own + 1) - lgamma(x + 1) - lgamma(own - x + 1) + lgamma(rest - own + 1) - lgamma(room - x + 1) - lgamma(rest - own - room + x + 1) - lgamma(rest + 1) + lgamma(room + 1) + lgamma(rest - room + 1))) AS w FROM (
          SELECT *, greatest(0, room - (rest - own), floor(mean - 8 * sqrt(greatest(0, mean * (1 - own / greatest(rest, 1)) * (rest - room) / greatest(rest - 1, 1))) - 1)::BIGINT) AS lo,
                 least(own, room, ceil(mean + 8 * sqrt(greatest(0, mean * (1 - own / greatest(rest, 1)) * (rest - room) / greatest(rest - 1, 1))) + 1)::BIGINT) AS hi FROM (
            SELECT tree.*, tree.q[i] AS own, room::DOUBLE * tree.q[i] / greatest(rest, 1) AS mean,
                   ((('0x' || substr(md5('mix:' || node || ':' || nos[i]), 1, 10))::BIGINT + 0.5::DOUBLE) + ((('0x' || substr(md5('mix:' || node || ':' || nos[i]), 11, 10))::BIGINT + 0.5::DOUBLE) / 1099511627776.0::DOUBLE - 0.5::DOUBLE)) / 1099511627776.0::DOUBLE AS u
            FROM tree, top WHERE level < levels AND i <= len(tree.q)))))
    UNION ALL
    SELECT level, 1, [2 * node, 2 * node + 1], 1, [list_sum(taken)::BIGINT, (list_sum(tree.q) - list_sum(taken))::BIGINT], [list_sum(taken)::BIGINT // 2, (list_sum(tree.q) - list_sum(taken))::BIGINT // 2], [taken, list_transform(tree.q, lambda x, j: x - taken[j])], []::BIGINT[]
    FROM tree, top WHERE level < levels AND i > len(tree.q))),
lf AS (SELECT node - (1 << levels) AS shard, unnest(nos) AS no, unnest(tree.q) AS n FROM tree, top WHERE level = levels),
st AS (SELECT no, shard, sum(n) OVER (PARTITION BY no ORDER BY shard) - n AS first, sum(n) OVER (PARTITION BY no ORDER BY shard) AS past FROM lf),
nu AS (SELECT doc_id, source, no, epoch, CASE WHEN epoch < epochs THEN n ELSE more END AS n_words, epoch * n_blocks + rank AS number FROM m, unnest(generate_series(0, passes - 1)) AS x(epoch)),
de AS (SELECT nu.*, shard, row_number() OVER (PARTITION BY shard ORDER BY md5('mix:place:' || nu.no || ':' || number), nu.no, number) - 1 AS position FROM nu JOIN st ON nu.no = st.no AND number >= first AND number < past),
bd AS (SELECT doc_id, source, sum(n_words)::BIGINT AS taken, count(*) AS n_blocks, count(DISTINCT shard) AS n_shards, min((shard, position)) AS head FROM de GROUP BY doc_id, source)
SELECT d.doc_id, d.size, d.source_size, d.target, coalesce(taken, 0)::BIGINT AS taken, coalesce(bd.n_blocks, 0)::BIGINT AS n_blocks, coalesce(n_shards, 0)::BIGINT AS n_shards, head[1]::BIGINT AS first_shard, head[2]::BIGINT AS first_position
FROM d LEFT JOIN bd ON d.doc_id = bd.doc_id AND d.source IS NOT DISTINCT FROM bd.source
"""


def _op3_sql() -> str:
    """The phrases, and diagonals of trigrams joined as text."""
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"({i}, '{label}', '{text}')" for i, (label, text) in enumerate(TEMPLATES))
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
ph(phrase, label, k) AS (VALUES {phrases}),
tp(template, label, txt) AS (VALUES {templates}),
pl AS (SELECT doc_id, label, i AS place FROM d, ph, unnest(generate_series(0, len(w) - k)) AS g(i) WHERE array_to_string(w[i + 1:i + k], ' ') = phrase),
b AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base FROM pl GROUP BY doc_id),
tg AS (SELECT template, label, len(string_split(txt, ' ')) AS t_words, i AS t, array_to_string(string_split(txt, ' ')[i + 1:i + 3], ' ') AS g FROM tp, unnest(generate_series(0, len(string_split(txt, ' ')) - 3)) AS u(i)),
dg AS (SELECT doc_id, i AS p, array_to_string(w[i + 1:i + 3], ' ') AS g FROM d, unnest(generate_series(0, len(w) - 3)) AS u(i)),
hit AS (SELECT DISTINCT doc_id, template, label, t_words, p - t AS diagonal, t, p FROM dg JOIN tg USING (g)),
dia AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 2 THEN 1 ELSE 0 END AS starts FROM (SELECT DISTINCT doc_id, template, diagonal FROM hit)),
cl AS (SELECT doc_id, template, diagonal, sum(starts) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS cluster FROM dia),
cv AS (SELECT doc_id, label, template, cluster, count(DISTINCT t + o) / any_value(t_words) AS cover FROM hit JOIN cl USING (doc_id, template, diagonal), unnest([0, 1, 2]) AS u(o) GROUP BY doc_id, label, template, cluster HAVING 100 * (max(p) + 3 - min(p)) <= {STRETCH} * any_value(t_words)),
m AS (SELECT doc_id, max(cover) AS best, list(label) FILTER (WHERE cover >= 0.8) AS sure FROM cv GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(base, ','), '') AS base_labels,
coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(sure, [])))), ','), '') AS labels, CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""


#: op4: all pairs of documents that share a shingle, for small tables.
_OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM d),
n AS (SELECT d.doc_id, count(g) AS n_shingles FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * inter >= 80 * (x.n_shingles + y.n_shingles - inter)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c ON node = doc_id
"""

_OP8_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT p.page_id, p.host, p.path, rh || rp AS rule, v, row_number() OVER (PARTITION BY p.page_id, p.host, p.path ORDER BY length(rh || rp) DESC NULLS LAST) AS n
      FROM p LEFT JOIN r ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict FROM f WHERE n = 1
"""

#: op11: the trees level by level, the siblings of every leaf's ancestors, and crc32 bit by bit.
_OP11_SQL = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, source, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT) AS chars
  FROM documents),
c AS (
  SELECT *, xor(list_reduce(chars, lambda crc, b: list_reduce(range(8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END, xor(crc, b)), 4294967295), 4294967295) AS crc FROM f),
h AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc % 2 = 0 THEN sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) END AS altered FROM c),
l AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank, count(*) OVER (PARTITION BY source) AS n FROM h),
t(level, source, i, digest, n) AS (
  SELECT 0::BIGINT, source, rank, leaf, n FROM l
  UNION ALL
  SELECT level + 1, source, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3 FROM t WHERE n > 1 GROUP BY level, source, i // 3, n),
r AS (SELECT source, digest AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM t WHERE n = 1),
u(level, i, digest, n) AS (
  SELECT 0::BIGINT, rank, subroot, n FROM r
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(digest, '' ORDER BY i)), (n + 2) // 3 FROM u WHERE n > 1 GROUP BY level, i // 3, n),
own AS (
  SELECT l.doc_id, l.source, l.rank AS leaf_rank, level, l.rank // (3 ** level)::BIGINT AS i FROM l, (SELECT DISTINCT level FROM t) WHERE 3 ** level < l.n),
low AS (
  SELECT own.source, own.leaf_rank, own.level, coalesce(string_agg(digest, '' ORDER BY t.i) FILTER (WHERE t.i < own.i), '') AS lhs, coalesce(string_agg(digest, '' ORDER BY t.i) FILTER (WHERE t.i > own.i), '') AS rhs
  FROM own JOIN t ON t.source IS NOT DISTINCT FROM own.source AND t.level = own.level AND t.i // 3 = own.i // 3 GROUP BY own.source, own.leaf_rank, own.level),
up AS (SELECT r.source, level, r.rank // (3 ** level)::BIGINT AS i FROM r, (SELECT DISTINCT level FROM u) WHERE 3 ** level < r.n),
high AS (
  SELECT up.source, up.level, coalesce(string_agg(digest, '' ORDER BY u.i) FILTER (WHERE u.i < up.i), '') AS lhs, coalesce(string_agg(digest, '' ORDER BY u.i) FILTER (WHERE u.i > up.i), '') AS rhs
  FROM up JOIN u ON u.level = up.level AND u.i // 3 = up.i // 3 GROUP BY up.source, up.level),
lows AS (SELECT source, leaf_rank, list({'l': lhs, 'r': rhs} ORDER BY level) AS steps FROM low GROUP BY ALL),
highs AS (SELECT source, list({'l': lhs, 'r': rhs} ORDER BY level) AS steps FROM high GROUP BY ALL),
p AS (
  SELECT l.*, subroot, (SELECT digest FROM u WHERE n = 1) AS root, list_concat(coalesce(lows.steps, []), coalesce(highs.steps, [])) AS steps
  FROM l JOIN r ON l.source IS NOT DISTINCT FROM r.source LEFT JOIN lows ON lows.source IS NOT DISTINCT FROM l.source AND leaf_rank = l.rank LEFT JOIN highs ON highs.source IS NOT DISTINCT FROM l.source),
q AS (
  SELECT *, list_reduce(steps, lambda a, s: {'l': sha256(s.l || a.l || s.r), 'r': ''}, {'l': coalesce(altered, leaf), 'r': ''}).l AS folded_root FROM p)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM q
"""

_OP13_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
w AS (SELECT *, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(d, i, 8))::BIGINT) AS x FROM h),
c AS (
  SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS a, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form != 'plain' THEN a END AS prefix_chars, CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": _OP1_SQL,
    "op3_license_scan": _op3_sql(),
    "op4_minhash_dedup": _OP4_SQL,
    "op5_substring_dedup": _OP5_SQL,
    "op8_url_filter": _OP8_SQL,
    "op11_merkle_manifest": _OP11_SQL,
    "op13_fill_in_middle": _OP13_SQL,
}
