"""The registered queries of the subpackage, each beside its SQL form where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillwork.session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, root: fn(Tables(spark, root))
    return fn


@_query
def op7_mix_sources(t: Tables) -> DataFrame:
    from tillwork.llm.mixing import mix_sources

    docs = t.documents.select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op7_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0|' || coalesce(doc_id::VARCHAR, 'null')) AS k, md5(coalesce(text, '')) AS k2
  FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS words, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT]::HUGEINT AS weight FROM s),
f AS (
  SELECT *, 3 * sum(words) OVER () - coalesce(sum(4 * words) OVER before, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS free
  FROM w WINDOW before AS (ORDER BY words::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
first_free AS (
  SELECT rest, free FROM f WHERE 4 * words * free > rest * weight ORDER BY words::DOUBLE / weight, place LIMIT 1),
t AS (
  SELECT f.source, f.words::BIGINT AS source_size,
         CASE WHEN x.free IS NULL OR 4 * words * x.free <= x.rest * weight THEN (2 * words)::DOUBLE
              ELSE (weight * x.rest)::DOUBLE / (2 * x.free)::DOUBLE END AS target
  FROM f LEFT JOIN first_free x ON true),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
c AS (
  SELECT d.doc_id, d.size, r.source_size, r.target, r.whole, floor(r.target)::BIGINT - r.whole * r.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.k2 ROWS UNBOUNDED PRECEDING)::BIGINT - d.size AS before
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, rest - before)) AS taken FROM c
"""


@_query
def op10_exact_top_k(t: Tables) -> DataFrame:
    from pyspark.sql import functions as F

    from tillwork.llm.topk import exact_top_k

    return exact_top_k(t.embeddings, F.col("vec_id") % 20 == 0, 20)


ORACLE["op10_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


@_query
def op3_substring_dedup(t: Tables) -> DataFrame:
    from tillwork.llm.substrings import remove_repeated_substrings

    return remove_repeated_substrings(t.documents)


ORACLE["op3_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
first AS (SELECT k, min(doc_id) AS doc FROM win GROUP BY k),
hit AS (SELECT win.doc_id, i FROM win JOIN first ON win.k = first.k AND first.doc < win.doc_id),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, range(13) r(j)),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) AS t, count(*) AS n
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i WHERE gone.i IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


@_query
def op6_minhash_near_dedup(t: Tables) -> DataFrame:
    from tillwork.llm.neardup import near_duplicate_groups

    return near_duplicate_groups(t.documents).drop("text_hash")


ORACLE["op6_minhash_near_dedup"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_transform(coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []),
         lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS x FROM d),
n AS (SELECT doc_id, len(x)::BIGINT AS n FROM s),
item AS (SELECT doc_id, unnest(x) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM item a JOIN item b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM common JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (
  SELECT a AS doc_id, b AS other FROM link UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(min(other), n.doc_id)) AS component_id,
       n.doc_id <= coalesce(min(other), n.doc_id) AS kept
FROM n LEFT JOIN reach ON n.doc_id = reach.doc_id GROUP BY n.doc_id, n.n
"""


@_query
def op4_quality_classifier(t: Tables) -> DataFrame:
    from pyspark.sql import functions as F

    from tillwork.llm.ngrams import fit_quality, fold_of, score_quality

    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    model = fit_quality(t.documents, t.labels.where(~held_out))
    scored = score_quality(t.documents, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@_query
def op9_lm_scoring(t: Tables) -> DataFrame:
    from pyspark.sql import functions as F

    from tillwork.llm.mixing_lm import score_texts
    from tillwork.llm.ngrams import fold_of

    return score_texts(t.documents, fold_of(F.col("doc_id"), 7), 2)


@_query
def op2_benchmark_decontamination(t: Tables) -> DataFrame:
    from tillwork.llm.decontaminate import find_leaks

    return find_leaks(t.documents, t.benchmark).select("doc_id", "item_id", "n_windows", "n_words", "similarity")


@_query
def op5_secret_scan(t: Tables) -> DataFrame:
    from tillwork.llm.secrets import fit_scanner, scan_secrets

    return scan_secrets(t.documents, fit_scanner(t.documents))


@_query
def op8_html_extraction(t: Tables) -> DataFrame:
    from tillwork.llm.html import extract_main_text, fit_extractor

    return extract_main_text(t.pages, fit_extractor(t.pages))


@_query
def op1_warc_revisits(t: Tables) -> DataFrame:
    from tillwork.llm.warc import deduplicate, read_headers, resolve, write_pages
    from tillwork.session import pin

    archives = deduplicate(t.spark, write_pages(t.pages))
    return resolve(pin(read_headers(t.spark, archives), "warc-read"))


ORACLE["op1_warc_revisits"] = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM r
"""


@_query
def op11_conversation_trie(t: Tables) -> DataFrame:
    from tillwork.llm.turn_trie import numbered_turns, prefix_trie, with_shared_openings

    return prefix_trie(*with_shared_openings(numbered_turns(t.conversations), every=20, most=3)).drop("node")


ORACLE["op11_conversation_trie"] = r"""
WITH c AS (
  SELECT conv_id, turn, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS id,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
word AS (SELECT id, max(words) AS words FROM c GROUP BY id),
o AS (
  SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS t,
         (xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
            lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
              lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 4)::INT AS h
  FROM c GROUP BY conv_id),
b AS (
  SELECT o.conv_id, coalesce(p.t[1:o.h], []) || o.t[o.h + 1:] AS t FROM o LEFT JOIN o p ON p.conv_id = o.conv_id - o.conv_id % 20),
m AS (
  SELECT conv_id, d, array_to_string(t[1:d], '') AS k, array_to_string(t[1:d - 1], '') AS up, len(t) = d AS ends, t[d] AS id
  FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM b)),
g AS (
  SELECT k, max(up) AS up, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(id) AS id,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS ends
  FROM m GROUP BY k, d),
kid AS (SELECT up AS k, count(*) AS n FROM g WHERE depth > 0 GROUP BY up),
v AS (
  SELECT g.*, coalesce(kid.n, 0) AS n_children, (g.n_convs - 1) * coalesce(words, 0) AS saved
  FROM g LEFT JOIN kid ON g.k = kid.k LEFT JOIN word ON word.id = g.id),
s AS (
  SELECT array_to_string(t[1:a], '') AS k, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(saved) AS saved_tokens
  FROM (SELECT t, n_children, saved, unnest(range(0, depth + 1)) AS a FROM v JOIN b ON b.conv_id = v.conv_id) GROUP BY 1)
SELECT v.conv_id, depth, CASE WHEN depth > 0 THEN p.conv_id END AS parent_conv_id, v.n_convs, n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN s ON v.k = s.k LEFT JOIN (SELECT k, conv_id FROM g) p ON p.k = v.up
"""


@_query
def op12_token_counts(t: Tables) -> DataFrame:
    import public_tokenizers

    from tillwork.llm.token_counts import count_tokens

    return count_tokens(t.documents, public_tokenizers.path("byte_bpe_50k.json"))


@_query
def op13_filter_audit(t: Tables) -> DataFrame:
    from tillwork.llm.filter_audit import audit_orders, failures

    return audit_orders(failures(t.documents, t.labels))


ORACLE["op13_filter_audit"] = r"""
WITH d AS (SELECT coalesce(lang, '') AS part, doc_id, coalesce(text, '') AS t FROM documents),
first AS (SELECT t, min(doc_id) AS f FROM d GROUP BY t),
l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
w AS (
  SELECT part, regexp_extract_all(d.t, '[^\x20\x09-\x0D]+') AS w, len(regexp_extract_all(d.t, '[A-Z]')) AS capitals, length(d.t) AS points,
         regexp_matches(d.t, '[#$%&*|]') AS markup, coalesce(d.doc_id > f, false) AS copy, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN first ON d.t = first.t LEFT JOIN l ON d.doc_id = l.doc_id),
k AS (
  SELECT part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * capitals > 3 * points, markup, copy] AS fail,
         count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM w GROUP BY ALL),
x AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
p AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (
  SELECT array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, step, o[step]::INT AS f, o[1:step - 1] AS earlier
  FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
m AS (
  SELECT part, filter_order, step, f, n, good, toxic, fail[f] AS fails, len(list_filter(earlier, lambda i: fail[i])) > 0 AS gone,
         len(list_filter(fail, lambda b: b)) = 1 AS single
  FROM k, s),
r AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END)::BIGINT AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN fails AND single THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM r
"""
