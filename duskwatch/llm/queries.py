"""Registered queries of the operators of this package, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskwatch.llm import bpe, cells, chat, cotrain, graphann, jaccard, katz, latent, resample, sharding, spelling, substring, tokenfile
from duskwatch.llm.store import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


@query
def op1_debruijn(spark, sf_dir):
    out = substring.dedup(table(spark, sf_dir, "documents"), k=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SQL["op1_debruijn"] = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
k AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
h AS (SELECT doc_id, i, md5_number(array_to_string(ws[i:i + 34], ' ')) AS g FROM k),
r AS (SELECT doc_id, i FROM h WHERE g IN (SELECT g FROM h GROUP BY g HAVING count(*) > 1)),
x AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
g AS (SELECT doc_id, list(p) AS ps FROM x GROUP BY doc_id),
f AS (SELECT w.doc_id, len(ws) AS n, list_filter(ws, lambda t, i: NOT list_contains(coalesce(ps, []), i)) AS kept, coalesce(len(ps), 0) AS gone FROM w LEFT JOIN g USING (doc_id))
SELECT doc_id, n AS n_words, gone AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM f
"""


@query
def op2_token_files(spark, sf_dir):
    vocabulary = _read(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfile.read_tokens(tokenfile.write_tokens(table(spark, sf_dir, "documents"), vocabulary, end=2, added=True))


@query
def op3_hypergeometric_shards(spark, sf_dir):
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    return sharding.shard(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query
def op4_katz(spark, sf_dir):
    model = katz.katz(table(spark, sf_dir, "documents"))
    return model.scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.facts.tokens).cast("long").alias("train_tokens"), "base_score", "score")


@query
def op5_ngram_jaccard(spark, sf_dir):
    return jaccard.join(table(spark, sf_dir, "documents"), n=3, num=90, den=100).select("doc_id", "n_shingles", "component_id")


SQL["op5_ngram_jaccard"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
n AS (SELECT doc_id, len(sh) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
      WHERE a.g IN (SELECT g FROM e GROUP BY g HAVING count(*) > 1) GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n AS n_shingles, c.component_id FROM n JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) c ON c.a = n.doc_id
"""


@query
def op6_pruned_graph(spark, sf_dir):
    return graphann.search(table(spark, sf_dir, "embeddings"), k=20, every=20)


@query
def op7_perspectives(spark, sf_dir):
    return chat.rotate(table(spark, sf_dir, "conversations"))


SQL["op7_perspectives"] = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t),
s AS (
  SELECT t.conv_id, perspective, turn, speaker, txt, perspective = speaker AS own,
         '<|im_start|>' || CASE WHEN perspective = speaker THEN 'assistant' ELSE 'user name=' || speaker END || chr(10) || txt || '<|im_end|>' || chr(10) AS segment
  FROM t JOIN p USING (conv_id)),
w AS (
  SELECT *, row_number() OVER o - 1 AS position,
         CAST(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, txt ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ending
  FROM s WINDOW o AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, txt))
SELECT conv_id, perspective, position, turn, speaker, CASE WHEN own THEN 'assistant' ELSE 'user' END AS role, segment,
       ending - length(segment) AS start, CAST(own AS INTEGER) AS mask,
       ending - CASE WHEN own THEN length(txt) + 11 ELSE 0 END AS mask_start, ending AS mask_end
FROM w
"""


@query
def op8_byte_bpe(spark, sf_dir):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_cotraining(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = cotrain.fit(docs, table(spark, sf_dir, "labels"))
    return cotrain.score(docs, model)


@query
def op10_latent_decontamination(spark, sf_dir):
    return latent.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: crc32 in SQL: the table of the 256 bytes' remainders from its rule, and a macro over the bytes of a text.
_CRC = """
t AS (SELECT list(v ORDER BY i) AS tab FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def _crc(text: str) -> str:
    codes = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INTEGER) + 1])), 4294967295)"


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query
def op11_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"), ratio=10, shortest=7, least=2, delete_every=31)


SQL["op11_spelling_variants"] = rf"""
WITH RECURSIVE {_CRC},
r AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS k FROM r GROUP BY doc_id, run),
h AS (SELECT run, n, {_crc("k")} AS h FROM d, t),
x AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM x WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
g AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
p AS (
  SELECT a.word AS word, b.word AS near, b.n AS m FROM g a JOIN g b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, v.word, v.n FROM g JOIN v ON g.rest = v.word
  UNION SELECT v.word, g.word, g.n FROM g JOIN v ON g.rest = v.word),
b AS (SELECT word, count(*) AS n_near, max(m) AS m FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * v.n THEN b.m END AS form_n FROM v LEFT JOIN b USING (word)),
o AS (SELECT f.word, min(p.near) AS form FROM f JOIN p ON p.word = f.word AND p.m = f.form_n GROUP BY f.word),
c AS (SELECT word, word AS root, 0 AS depth FROM v UNION ALL SELECT c.word, o.form, depth + 1 FROM c JOIN o ON c.root = o.word),
e AS (SELECT word, max_by(root, depth) AS root FROM c GROUP BY word)
SELECT f.word, o.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN e USING (word) LEFT JOIN o USING (word)
"""


@query
def op12_line_resampling(spark, sf_dir):
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample.resample(docs, target, max_n=1, buckets=10000, min_words=20, percent=10, seed="2024")


def _bucketed(name: str, id_col: str) -> str:
    words = f"regexp_extract_all({_LOWER.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"SELECT {id_col} AS id, unnest({words}) AS w FROM {name}"


SQL["op12_line_resampling"] = rf"""
WITH {_CRC},
dw AS ({_bucketed("documents", "doc_id")}),
bw AS ({_bucketed("benchmark", "item_id")}),
u AS (SELECT w, {_crc("w")} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM bw), t),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN u USING (w) GROUP BY bucket),
b AS (SELECT bucket, count(*) AS t FROM bw JOIN u USING (w) GROUP BY bucket),
n AS (SELECT CAST((SELECT count(*) FROM dw) AS DOUBLE) AS big_s, CAST((SELECT count(*) FROM bw) AS DOUBLE) AS big_t),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (big_s + 10000) / ((s + 1.0::DOUBLE) * (big_t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN b USING (bucket), n),
f AS (SELECT id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN u USING (w) JOIN g USING (bucket) GROUP BY id),
h AS (SELECT doc_id, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM documents),
c AS (SELECT h.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h LEFT JOIN f ON f.id = h.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM c WHERE n_features >= 20),
k AS (SELECT 10 * count(*) // 100 AS k FROM r)
SELECT c.doc_id, n_features, weight, score, r.rank FROM c LEFT JOIN (SELECT doc_id, rank FROM r, k WHERE rank <= k) r ON r.doc_id = c.doc_id
"""


@query
def op13_cell_links(spark, sf_dir):
    return cells.link(table(spark, sf_dir, "embeddings"), threshold=0.95)


SQL["op13_cell_links"] = r"""
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
g AS (SELECT vec_id, v FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""
