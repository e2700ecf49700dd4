"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixspark.llm import ann, codes, dedup, mixing, packing, pii, prefixes, quality, rules, sharding, tokens, topk, warc

from helixspark.llm.shared import staged


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, percent=85).drop("text_key")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    slim = staged(docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("tie")), "sizes")
    return mixing.mix_sources(slim, size=F.col("size"), tie=F.col("tie")).select("doc_id", "size", "source_size", "target", "taken")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    usable = F.when(topk.V.whole(F.col("embedding")), whole)
    return topk.top_products(vectors.select("vec_id", usable.alias("vector")), F.col("id") % 50 == 0)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return warc.write(pages).lookup(pages).drop("payload", "url_key")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs)
    of = lambda k: F.size(F.filter("pii_spans", lambda x: x["kind"] == k)).cast("long")
    base = F.filter("pii_spans", lambda x: x["kind"] < len(pii.BASE))
    return found.select("doc_id", *(of(k).alias(f"n_{kind}") for k, kind in enumerate(pii.BASE)), F.sha2(pii.span_text(base).cast("binary"), 256).alias("base_sha256"), pii.span_text(F.col("pii_spans")).alias("spans"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, coder = codes.compress(_table(spark, sf_dir, "embeddings"))
    books = hashlib.sha256(coder.text().encode() if coder else b"").hexdigest()
    summed = codes.total_by_label(staged(coded, "codes"))
    return summed.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books).alias("codebooks_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.with_digests(prefixes.trie(_table(spark, sf_dir, "conversations")))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_pack": op3_pack,
    "op4_mix": op4_mix,
    "op5_shard": op5_shard,
    "op6_quality": op6_quality,
    "op7_top_products": op7_top_products,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_pii": op10_pii,
    "op11_codes": op11_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_quality_rules": op13_quality_rules,
}


def _codes_sql() -> str:
    """op11: assignments and means of its four rounds, one after another."""
    near = """
a{k} AS MATERIALIZED (SELECT x.n, x.vec_id, x.label, x.p, x.x, min(list_sum(list_transform(list_zip(x.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * 256 + b.k) AS m
  FROM parts x JOIN b{k} b ON b.p = x.p GROUP BY ALL)"""
    mean = """,
s{k} AS (SELECT p, m % 256 AS k, i, sum(v)::HUGEINT AS s, count(*) AS c FROM (SELECT p, m, unnest(x) AS v, unnest(range(len(x))) AS i FROM a{k}) GROUP BY ALL),
m{k} AS (SELECT p, k, list((CASE WHEN s < 0 AND s % c <> 0 THEN s // c - 1 ELSE s // c END)::BIGINT ORDER BY i) AS x FROM s{k} GROUP BY ALL),
b{next} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.k = b.k),"""
    start = """
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
parts AS MATERIALIZED (SELECT n, vec_id, label, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS x FROM kept, range(4) AS t(p)),
b0 AS MATERIALIZED (SELECT p, n - 1 AS k, x FROM parts WHERE n <= 256),"""
    end = """,
books AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, k, i)) AS s FROM (SELECT p, k, unnest(x) AS v, unnest(range(len(x))) AS i FROM b4)),
coded AS (SELECT n, vec_id, label, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, sum(m // 256)::BIGINT AS error FROM a4 GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256 FROM coded, books"""
    return start + "".join((near + mean).format(k=k, next=k + 1) for k in range(codes.ROUNDS)) + near.format(k=codes.ROUNDS) + end


#: op1 is approximate; op3, op6, op9 need a tokenizer or a trained model, op13 a fit of many rounds, op5 and op10 hashes or checks that SQL engines don't share.
SQL: dict[str, str] = {
    "op2_near_duplicates": """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM words),
classes AS (SELECT min(doc_id) AS c, s FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT c, len(s) AS n, unnest(s) AS x FROM classes),
near AS (
  SELECT a.c AS a, b.c AS b FROM items a JOIN items b ON a.x = b.x AND a.c < b.c
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach AS (SELECT c AS a, c AS b FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.component, s.doc_id) AS component_id, coalesce(l.component, s.doc_id) = s.doc_id AS kept
FROM sets s LEFT JOIN classes c ON c.s = s.s LEFT JOIN least l ON l.a = c.c""",
    "op4_mix": """
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
    ('0x' || substr(md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15))::BIGINT AS key FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM docs GROUP BY source),
caps AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(n - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS cap FROM sizes),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
best AS (SELECT max(level) AS level FROM levels WHERE level * weight <= cap),
goals AS (SELECT l.source, l.source_size, CASE WHEN b.level IS NULL THEN l.cap ELSE least(l.cap, b.level * l.weight) END AS target FROM levels l, best b),
cut AS (
  SELECT *, round(target)::BIGINT AS t, CASE WHEN source_size > 0 THEN floor(round(target) / source_size)::BIGINT ELSE 0 END AS whole FROM goals),
placed AS (
  SELECT d.*, c.source_size, c.target, c.t, c.whole,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs d JOIN cut c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (whole * size + least(greatest(t - whole * source_size - before, 0), size))::BIGINT AS taken FROM placed""",
    "op7_top_products": """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
parts AS (SELECT vec_id, len(v) AS dim, unnest(v) AS x, unnest(range(len(v))) AS at FROM vectors),
products AS (
  SELECT q.vec_id AS query_id, d.vec_id, sum(q.x * d.x)::BIGINT AS score FROM parts q JOIN parts d ON q.at = d.at AND q.dim = d.dim AND q.vec_id <> d.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, d.vec_id),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM products)
SELECT * FROM ranked WHERE rank <= 5""",
    "op8_warc": """
WITH payloads AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM payloads)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM firsts""",
    "op11_codes": _codes_sql(),
    "op12_prefix_trie": """
WITH turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos,
    length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(t ORDER BY pos) AS t, list(w ORDER BY pos) AS w FROM turns GROUP BY c),
heads AS (
  SELECT *, c - c % 20 AS base, (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b:
    list_reduce(list_prepend(xor(a, b), range(8)), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r // 2, 3988292384) ELSE r // 2 END))) % 4 AS h FROM own),
rebuilt AS (
  SELECT a.c, coalesce(b.t, [])[1 : a.h] || a.t[a.h + 1 :] AS t, coalesce(b.w, [])[1 : a.h] || a.w[a.h + 1 :] AS w FROM heads a LEFT JOIN own b ON b.c = a.base),
members AS (SELECT c, d, t[1 : d] AS node, CASE WHEN d > 0 THEN t[1 : d - 1] END AS parent, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w, d = len(t) AS ends FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, d, any_value(parent) AS parent, any_value(w) AS w, min(c) AS c, count(*) AS n, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
  FROM members GROUP BY node, d),
counted AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN (SELECT parent, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY parent) k ON k.parent = n.node),
above AS (SELECT node, node[1 : unnest(range(d + 1))] AS top, n_children, (n - 1) * w AS saved FROM counted),
sums AS (SELECT top, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY top)
SELECT n.c AS conv_id, n.d AS depth, p.c AS parent_conv_id, n.n AS n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN sums s ON s.top = n.node LEFT JOIN nodes p ON p.node = n.parent""",
}
