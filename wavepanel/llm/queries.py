"""The registered queries of this subpackage: name -> (builder, DuckDB SQL or None).

Each applies its operator, with its defaults, to the whole of its tables.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavepanel.llm import bpe, byte_bpe, exact_dedup, fill_middle, line_dedup, mixing, near_dedup, phrases, quality, suffix_dedup, token_counts, toxicity, url_filter
from wavepanel.llm.common import materialise, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each pass of the mixture over a document; the budget is the corpus's number of words."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "n_tokens", "weight_ppb", "mix_pass", "mix_block", "mix_key")


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n,
         md5('wavepanel|cut|' || coalesce(source, '') || '|' || coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS tokens FROM d GROUP BY source HAVING sum(n) > 0),
p AS (SELECT source, tokens, tokens::DOUBLE / (sum(tokens) OVER ())::DOUBLE AS p FROM s),
ends AS (SELECT -sum(p * ln(p)) AS h1, ln(count(*)) AS h0, 1 / (count(*) * min(p)) AS most FROM p),
goal AS (SELECT h1 + (h0 - h1) * 0.5 AS h, h0, most FROM ends),
halving AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0.0::DOUBLE AS lo2, 1.0::DOUBLE AS hi2
  UNION ALL
  SELECT i + 1,
         CASE WHEN flat THEN m ELSE lo END, CASE WHEN flat THEN hi ELSE m END,
         CASE WHEN often THEN m2 ELSE lo2 END, CASE WHEN often THEN hi2 ELSE m2 END
  FROM (
    SELECT i, lo, hi, lo2, hi2, (lo + hi) / 2 AS m, (lo2 + hi2) / 2 AS m2,
           ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) > min(h) AS flat,
           pow(min(p), (lo2 + hi2) / 2 - 1) / sum(pow(p, (lo2 + hi2) / 2)) > 4 AS often
    FROM halving CROSS JOIN p CROSS JOIN goal WHERE i < 40 GROUP BY i, lo, hi, lo2, hi2)),
a AS (SELECT greatest(CASE WHEN h0 > h THEN hi ELSE 0 END, CASE WHEN most > 4 THEN hi2 ELSE 0 END) AS a FROM halving CROSS JOIN goal WHERE i = 40),
w AS (SELECT source, tokens, round(pow(p, a) / sum(pow(p, a)) OVER () * 1000000000)::BIGINT AS ppb, sum(tokens) OVER () AS budget FROM p CROSS JOIN a),
due AS (SELECT source, tokens, ppb, (ppb::HUGEINT * budget::HUGEINT // 1000000000)::BIGINT AS due FROM w),
passes AS (SELECT source, tokens, ppb, due // tokens AS fully, due % tokens AS rest, due // tokens + (due % tokens)::DOUBLE / tokens AS reps FROM due),
run AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY k RANGE UNBOUNDED PRECEDING) AS upto FROM d),
take AS (
  SELECT doc_id, run.source, n, ppb, k, fully, reps, unnest(range(0, fully + (CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END))) AS pass
  FROM run JOIN passes ON run.source IS NOT DISTINCT FROM passes.source),
keyed AS (SELECT *, CASE WHEN pass = fully THEN k ELSE md5(pass::VARCHAR || '|' || k) END AS key FROM take)
SELECT doc_id, source, n AS n_tokens, ppb AS weight_ppb, pass::INTEGER AS mix_pass,
       least(floor((pass + ('0x' || key[1:12])::BIGINT::DOUBLE / 281474976710656.0) / reps * 1024), 1023)::INTEGER AS mix_block, key AS mix_key
FROM keyed
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a similarity of 0.85 over three-word shingles."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
way AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM way UNION SELECT reach.a, way.b FROM reach JOIN way ON reach.b = way.a),
nearest AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(nearest.b, w.doc_id)) AS component_id,
       w.doc_id <= coalesce(nearest.b, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN nearest ON nearest.a = w.doc_id
"""


OP3_BATCHES = 2  # deliveries in which the table reaches the index


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table in two deliveries (by CRC-32 of the id) against one new index; the rows that stay are settled over both."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    batch = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % OP3_BATCHES
    name = f"llm_digests_{uuid.uuid4().hex}"
    index = exact_dedup.DigestIndex(spark, name, path=f"{shared_dir(spark)}/{name}")
    judged = [exact_dedup.exact_dedup(docs.where(batch == k), index).select("doc_id", "text_sha256") for k in range(OP3_BATCHES)]
    settled = materialise(index.settled(), "exact-settled")
    index.drop()
    rows = judged[0]
    for more in judged[1:]:
        rows = rows.unionByName(more)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return rows.join(settled, F.unhex("text_sha256") == F.col("digest")).select("doc_id", "keep_id", "group_size", kept, "text_sha256")


OP3_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY bare) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY bare ORDER BY n DESC, doc_id) AS kept,
       sha256(bare) AS text_sha256
FROM t
"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the 50-byte strings that an earlier document has."""
    out = suffix_dedup.suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["last"] - s["first"])
    return out.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.coalesce(F.sha2("kept", 256), "text_sha256").alias("kept_sha256"),
    )


OP4_SQL = r"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
g AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 49, 0))) AS p FROM h)),
m AS (SELECT s, min(doc_id) AS lo FROM g GROUP BY s),
hit AS (SELECT g.doc_id, p FROM g JOIN m ON g.s = m.s WHERE lo < g.doc_id),
mark AS (SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, true)::INTEGER AS new FROM hit),
grp AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM mark),
span AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS b FROM grp GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS was FROM span),
cut AS (
  SELECT gap.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, (2 * was + 1)::BIGINT, (2 * (a - was))::BIGINT), '' ORDER BY a) || substr(min(h), (2 * max(b) + 1)::BIGINT) AS rest
  FROM gap JOIN h ON gap.doc_id = h.doc_id GROUP BY gap.doc_id)
SELECT h.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM h LEFT JOIN cut ON h.doc_id = cut.doc_id
"""


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text that they decode to, as digests."""
    spec = bpe.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = bpe.decode(bpe.encode(docs, spec).drop("text"), spec)
    return out.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under a unigram model over a public vocabulary, scored by rank."""
    scores = token_counts.zipf_scores(token_counts.read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return token_counts.token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), scores).drop("text")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a classifier trained on labelled rows outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", F.coalesce(toxicity.fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


#: Hosts whose pages the list of URLs names.
LISTED_HOSTS = r"(^|\.)(spam-farm|cheap-pills)\."


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by the rules and by the list: the URLs seen on hosts known for spam."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(url_filter.host_of(F.col("url")).rlike(LISTED_HOSTS)).select(url_filter.canonical(F.col("url")).alias("canon"))
    return url_filter.url_filter(pages, listed).select("page_id", "host", "path", "rule", "verdict", "canon", "listed")


OP8_SQL = r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
                     lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=&]*|ref|fbclid|gclid)(=|$)')) AS args
  FROM pages),
c AS (
  SELECT page_id, host, path,
         CASE WHEN host <> '' THEN regexp_replace(host, '^www\.', '') || regexp_replace(path, '/+$', '')
              || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END END AS canon
  FROM u),
bad AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills)\.') AND canon IS NOT NULL),
r(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(r.verdict, length(h || p)) AS verdict
  FROM c JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT c.page_id, c.host, c.path, fit.rule, coalesce(fit.verdict, CASE WHEN bad.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       c.canon, bad.canon IS NOT NULL AS listed
FROM c LEFT JOIN bad ON c.canon = bad.canon LEFT JOIN fit ON c.page_id = fit.page_id
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document: counts, and the SHA-256 of the remaining text."""
    out = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return out.select("doc_id", "n_lines", "n_removed_lines", "n_removed_chunks", sha)


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
h AS (SELECT *, ('0x' || md5(line)[1:8])::BIGINT AS h FROM l),
r AS (
  SELECT doc_id, line, i, (coalesce(lag(h) OVER d, 0) * 65599 + h) % 4294967296 AS r, count(*) OVER (PARTITION BY doc_id) AS n
  FROM h WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
e AS (
  SELECT doc_id, line, i, coalesce(i BETWEEN 2 AND n - 2 AND r < lag(r) OVER d AND r < lead(r) OVER d, false) AS ends
  FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
k AS (
  SELECT doc_id, line, i,
         coalesce(sum(ends::INTEGER) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k
  FROM e),
c AS (SELECT doc_id, k, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM k GROUP BY doc_id, k),
f AS (SELECT *, n > 1 AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, k) > 1 AS gone FROM c)
SELECT doc_id, sum(n)::BIGINT AS n_lines, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines, count(*) FILTER (gone) AS n_removed_chunks,
       sha256(coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's statistics and verdict; trusted are the documents labelled as of good quality."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs, trusted(spark, sf_dir)).drop("text")


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text transformed, and rebuilt from what came out, as digests."""
    made = fill_middle.fill_middle(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return fill_middle.restore(made).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256")
    )


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
h AS (
  SELECT doc_id, x, n, ('0x' || k[1:8])::BIGINT % (n + 1) AS c1, ('0x' || k[9:16])::BIGINT % (n + 1) AS c2,
         x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR ('0x' || k[17:24])::BIGINT % 100 >= 90 AS plain,
         ('0x' || k[25:32])::BIGINT % 100 < 20 AS spm
  FROM t),
c AS (
  SELECT doc_id, x, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, least(c1, c2) AS a, greatest(c1, c2) - least(c1, c2) AS b,
         substring(x, 1, least(c1, c2)) AS p, substring(x, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS m, substring(x, greatest(c1, c2) + 1) AS s
  FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
       sha256(x) AS restored_sha256
FROM c
"""


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best-scored phrases of each language of the whole corpus."""
    return phrases.collocations(_table(spark, sf_dir, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS w FROM p),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM w CROSS JOIN (VALUES (1), (2), (3), (4), (5)) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND n >= 100),
cut AS (SELECT lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') AS head, array_to_string(ws[j + 1:k], ' ') AS tail FROM c CROSS JOIN (VALUES (1), (2), (3), (4)) AS t(j) WHERE j < k),
s AS (
  SELECT cut.lang, cut.k, cut.phrase, a, j, x.n AS l, y.n AS r, total.n AS n, ((1000::HUGEINT * a * total.n) // (x.n::HUGEINT * y.n))::BIGINT AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail JOIN total ON total.lang = cut.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
alone AS (
  SELECT * FROM best WHERE NOT EXISTS (
    SELECT 1 FROM c WHERE c.lang = best.lang AND c.k > best.k AND c.a >= best.a AND contains(' ' || c.phrase || ' ', ' ' || best.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM alone QUALIFY rank <= 2000
"""


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the bytes that they decode to, as digests."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text"), ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0").select("doc_id")


QUERIES = {
    "op1_mix_sources": (op1_mix_sources, OP1_SQL),
    "op2_near_dedup": (op2_near_dedup, OP2_SQL),
    "op3_exact_dedup": (op3_exact_dedup, OP3_SQL),
    "op4_suffix_dedup": (op4_suffix_dedup, OP4_SQL),
    "op5_bpe": (op5_bpe, None),
    "op6_token_counts": (op6_token_counts, None),
    "op7_toxicity": (op7_toxicity, None),
    "op8_url_filter": (op8_url_filter, OP8_SQL),
    "op9_line_dedup": (op9_line_dedup, OP9_SQL),
    "op10_quality_rules": (op10_quality_rules, None),
    "op11_fill_middle": (op11_fill_middle, OP11_SQL),
    "op12_phrases": (op12_phrases, OP12_SQL),
    "op13_byte_bpe": (op13_byte_bpe, None),
}
