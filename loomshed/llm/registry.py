"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomshed.session import table

RANKS_FILE = "byte_bpe_multi_50k.tiktoken"
MODEL_FILE = "piece_bpe_32k.model"


def tokenizer(spark: SparkSession, path: str | None = None) -> tuple[bytes, str]:
    """Rank bytes and pattern of the public vocabulary; ``path`` overrides the installed file."""
    import public_tokenizers
    from loomshed.llm import bpe

    return bpe.read_ranks(spark, path or public_tokenizers.path(RANKS_FILE)), public_tokenizers.PATTERN


# Words that mark a page as unwanted, whoever serves it.
UNWANTED = ("adult", "bets", "casino", "payday", "pills", "porn", "spam", "viagra")


def op1_url_reputation(spark: SparkSession, sf: str) -> DataFrame:
    """Host reputation under five rules. Outcomes: whether a page's own source names an unwanted trade."""
    from loomshed.llm.url_reputation import Rule, judge_pages, named_in

    rules = [
        Rule("allow", "com/"),
        Rule("block", "example.com/en/"),
        Rule("allow", "www.example.com/en/"),
        Rule("block", "net/es/"),
        Rule("block", "net/fr/"),
    ]
    pages = table(spark, sf, "pages")
    return judge_pages(pages, pages.select("page_id", named_in(F.col("html"), list(UNWANTED)).alias("good")), rules)


OP1_SQL = r"""
WITH tails AS (
  SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END, '') AS tail FROM pages),
raws AS (SELECT page_id, tail, regexp_extract(tail, '^[^/?#]*') AS raw FROM tails),
parts AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(tail, length(raw) + 1), '^[^?#]*') AS path FROM raws),
outcomes AS (
  SELECT page_id, min(CASE WHEN html IS NOT NULL THEN CASE WHEN regexp_matches(html, '(?i)\b(adult|bets|casino|payday|pills|porn|spam|viagra)\b') THEN 0 ELSE 1 END END) AS good
  FROM pages WHERE page_id IS NOT NULL GROUP BY page_id),
split AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '[.]$', '') AS name FROM (
  SELECT p.host, count(good) AS n, coalesce(sum(CASE WHEN good > 0 THEN 1 WHEN good IS NOT NULL THEN 0 END), 0)::BIGINT AS k
  FROM parts p LEFT JOIN outcomes USING (page_id) GROUP BY p.host)),
two AS (SELECT *, string_split(name, '.') AS l, array_to_string(string_split(name, '.')[-2:], '.') AS t2, regexp_matches(name, '^([0-9]+(\.[0-9]+){3}|\[.*\])$') AS number FROM split),
doubled AS (SELECT *, regexp_matches(t2, '^(ac|co|com|edu|go|gob|gov|mil|ne|net|nom|or|org)\.[a-z]{2}$') AS double FROM two),
hosts AS (
  SELECT host, n, k,
    CASE WHEN number THEN name WHEN double THEN array_to_string(l[-3:], '.') ELSE t2 END AS domain,
    CASE WHEN number THEN '(address)' WHEN double THEN t2 ELSE array_to_string(l[-1:], '.') END AS suffix
  FROM doubled),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
total AS (SELECT (coalesce(sum(k), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM suffixes),
s0 AS (SELECT suffix, n, k, m FROM suffixes, total),
s1 AS (SELECT sum(n * (k / n - m) * (k / n - m)) AS s2, sum(m * (1 - m)) AS v, sum(n * m * (1 - m)) AS nv, sum(n) AS n, count(*) AS c FROM s0 WHERE n > 0),
sl AS (SELECT CASE WHEN c < 2 THEN 2.0 WHEN (s2 - v) / n <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, nv / n / ((s2 - v) / n) - 1)) END::DOUBLE AS t FROM s1),
s AS (SELECT suffix, (k + t * m) / (n + t) AS mean FROM s0, sl),
d0 AS (SELECT domain, suffix, n, k, mean AS m FROM domains JOIN s USING (suffix)),
d1 AS (SELECT sum(n * (k / n - m) * (k / n - m)) AS s2, sum(m * (1 - m)) AS v, sum(n * m * (1 - m)) AS nv, sum(n) AS n, count(*) AS c FROM d0 WHERE n > 0),
dl AS (SELECT CASE WHEN c < 2 THEN 2.0 WHEN (s2 - v) / n <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, nv / n / ((s2 - v) / n) - 1)) END::DOUBLE AS t FROM d1),
d AS (SELECT domain, suffix, (k + t * m) / (n + t) AS mean FROM d0, dl),
h0 AS (SELECT host, n, k, mean AS m FROM hosts JOIN d USING (domain, suffix)),
h1 AS (SELECT sum(n * (k / n - m) * (k / n - m)) AS s2, sum(m * (1 - m)) AS v, sum(n * m * (1 - m)) AS nv, sum(n) AS n, count(*) AS c FROM h0 WHERE n > 0),
hl AS (SELECT CASE WHEN c < 2 THEN 2.0 WHEN (s2 - v) / n <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, nv / n / ((s2 - v) / n) - 1)) END::DOUBLE AS t FROM h1),
h2 AS (SELECT host, n, (k + t * m) / (n + t) AS mean, n + t AS total FROM h0, hl),
h AS (SELECT host, n, mean, least(1.0, mean + 1.64::DOUBLE * sqrt(mean * (1 - mean) / (total + 1))) AS upper FROM h2),
ruled AS (
  SELECT page_id, p.host, path, n, mean, upper,
    CASE WHEN (p.host = 'www.example.com' OR p.host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (p.host = 'example.com' OR p.host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (p.host = 'net' OR p.host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (p.host = 'com' OR p.host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts p LEFT JOIN h ON p.host = h.host)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN upper < 0.8 THEN 'block' ELSE 'allow' END AS verdict,
  n AS host_outcomes, round(mean, 6) AS mean_good, round(upper, 6) AS upper_good
FROM ruled
"""


def op2_warc(spark: SparkSession, sf: str) -> DataFrame:
    """Write every page to deduplicated archives, read them back and resolve revisits."""
    from loomshed.llm.common import drop_path, scratch, stored
    from loomshed.llm.warc import read_archives, resolve, write_archives

    path = scratch(spark, "warc")
    write_archives(table(spark, sf, "pages"), path)
    found = stored(read_archives(spark, path).drop("payload", "url"), "warc-records")
    drop_path(spark, path)
    return resolve(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH heads AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
last AS (SELECT payload_digest, max(page_id) AS page FROM heads WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, h.payload_digest,
  CASE WHEN page IS NULL OR page = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page <> page_id THEN page END AS refers_to
FROM heads h LEFT JOIN last l ON h.payload_digest = l.payload_digest
"""


def op3_media_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk every document as a picture, store it deduplicated, rebuild and describe it."""
    from loomshed.llm.media import rebuild, write_store

    return rebuild(write_store(table(spark, sf, "documents")))


def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Encode and decode every document."""
    from loomshed.llm.bpe import encode_documents

    ranks, pattern = tokenizer(spark)
    return encode_documents(table(spark, sf, "documents"), ranks, pattern, keep_ids=False).drop("token_ids")


def op5_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """The five best others of every vector whose id is divisible by 50."""
    from loomshed.llm.topk import top_k

    return top_k(table(spark, sf, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH fine AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
ints AS (SELECT r, vec_id, list_transform(e, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM fine),
scores AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM ints q JOIN ints c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scores QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 5
"""


def op6_training_order(spark: SparkSession, sf: str) -> DataFrame:
    """Write every document's sequences in permuted order as fixed-stride shards, and read them back."""
    from loomshed.llm.common import scratch
    from loomshed.llm.materialise import byte_pair_tokeniser, read_shards, write_shards

    ranks, pattern = tokenizer(spark)
    path = scratch(spark, "shards")
    if not write_shards(table(spark, sf, "documents"), path, byte_pair_tokeniser(ranks, pattern)):
        return spark.createDataFrame([], "slot long, n_ids int, ids_sha256 string")
    ids = read_shards(spark, path)
    # Only a sequence that ends with padding is searched for its beginning.
    padded = F.substring("ids", -2, 2) == F.lit(b"\xff\xff")
    pad = F.when(padded, F.length(F.regexp_extract(F.hex("ids"), "(FFFF)*$", 0)) / 4).otherwise(0)
    return ids.select(
        "slot", (F.octet_length("ids") / 2 - pad).cast("int").alias("n_ids"), F.sha2("ids", 256).alias("ids_sha256")
    )


def op7_curriculum(spark: SparkSession, sf: str) -> DataFrame:
    """The mix's plan for every document, in training order of first copies."""
    from loomshed.llm.mixing import in_order, plan

    p = plan(table(spark, sf, "documents").select("doc_id", "source", "text"))
    first = F.try_element_at("positions", F.lit(1))
    told = in_order(p.select("doc_id", "size", "source_size", "target", "taken", first.alias("position"), "tie"))
    return told.drop("tie")


OP7_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM sizes GROUP BY source),
weighed AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][idx % 3 + 1] AS weight, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][idx % 3 + 1] AS slope, 2.0::DOUBLE * source_size AS cap FROM sources),
filled AS (
  SELECT *, cap / weight AS fullness,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
lam AS (SELECT level FROM filled WHERE level <= fullness ORDER BY fullness, idx LIMIT 1),
told AS (SELECT source, source_size, slope, least(cap, coalesce((SELECT level FROM lam) * weight, cap)) AS target FROM filled),
placed AS (
  SELECT doc_id, s.source, size, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sizes s)
SELECT doc_id, size, source_size, target,
  (CASE WHEN size > 0 AND start < target THEN size ELSE 0 END + CASE WHEN size > 0 AND start + source_size < target THEN size ELSE 0 END)::BIGINT AS taken,
  CASE WHEN size > 0 AND start < target THEN round(CASE WHEN slope = 0 THEN start / target
    ELSE (sqrt(greatest((1 - slope) * (1 - slope) + 4 * slope * (start / target), 0.0)) - (1 - slope)) / (2 * slope) END, 9) + 0.0::DOUBLE END AS position
FROM placed p JOIN told t ON p.source IS NOT DISTINCT FROM t.source
"""


def op8_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate components over two-word shingles."""
    from loomshed.llm.neardup import NearDup, near_duplicates

    return near_duplicates(table(spark, sf, "documents"), NearDup(words=2))


OP8_SQL = r"""
WITH RECURSIVE tokens AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT r, doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) = 1 THEN w
    ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM tokens),
items AS (SELECT r, len(s) AS n, unnest(s) AS x FROM sets WHERE doc_id IS NOT NULL),
pairs AS (
  SELECT a.r AS a, b.r AS b, a.n AS na, b.n AS nb, count(*) AS both_
  FROM items a JOIN items b ON a.x = b.x AND a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * both_ >= 80 * (na + nb - both_)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(r, c) AS (
  SELECT r, r FROM sets UNION SELECT e.b, x.c FROM reach x JOIN edges e ON e.a = x.r WHERE x.c < e.b),
roots AS (SELECT r, min(c) AS root FROM reach GROUP BY r),
least AS (SELECT root, min(doc_id) AS component_id FROM roots JOIN sets USING (r) GROUP BY root)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, coalesce(doc_id = component_id, true) AS kept
FROM sets JOIN roots USING (r) JOIN least USING (root)
"""


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document; learned from the rows whose crc32 is not divisible by 5."""
    from loomshed.llm.toxicity import score_documents, train

    docs = table(spark, sf, "documents")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    labels = table(spark, sf, "labels").select("doc_id", "toxic").filter(~held)
    model = train(docs, labels)
    scored = score_documents(docs, model)
    return scored.select(
        "doc_id",
        F.coalesce(held, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_hits",
        "n_near",
        "n_quoted",
    )


def op10_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data of every document, as counts, a digest of the base spans and all spans."""
    from loomshed.llm.pii import KINDS, find_documents, train

    docs = table(spark, sf, "documents")
    found = find_documents(docs, train(docs))

    def text(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def rank(s):
        return F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])

    merged = F.transform(
        F.array_sort(
            F.transform(
                F.concat("base", "added"),
                lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
            )
        ),
        lambda s: s,
    )

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        text(merged).alias("spans"),
        F.size("added").alias("n_added"),
    )


def op11_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    from loomshed.llm.trie import numbered, prefix_trie, rebuilt

    return prefix_trie(rebuilt(numbered(table(spark, sf, "conversations"))))


OP11_SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) r(i))),
turns AS MATERIALIZED (
  SELECT conv_id, strlen(tx) AS bytes, length(ro) || ':' || ro || tx AS item,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, ro, sha256(tx)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS ro, coalesce(text, '') AS tx FROM conversations WHERE conv_id IS NOT NULL)),
plan AS (
  SELECT conv_id, n, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT conv_id, count(*) AS n FROM turns GROUP BY 1), crc),
rebuilt AS (
  SELECT p.conv_id, t.pos AS depth, item, bytes FROM plan p JOIN turns t ON t.conv_id = p.base AND t.pos <= h
  UNION ALL
  SELECT p.conv_id, t.pos - p.h + least(p.h, coalesce(b.n, 0)), item, bytes
  FROM plan p JOIN turns t ON t.conv_id = p.conv_id AND t.pos > p.h LEFT JOIN plan b ON b.conv_id = p.base),
seqs AS MATERIALIZED (
  SELECT p.conv_id, coalesce(list(item ORDER BY depth) FILTER (item IS NOT NULL), []) AS s,
    coalesce(list(bytes ORDER BY depth) FILTER (item IS NOT NULL), []) AS b
  FROM plan p LEFT JOIN rebuilt r ON r.conv_id = p.conv_id GROUP BY 1),
prefixes AS (SELECT conv_id, d, s[1:d] AS p, s[1:d - 1] AS up, b[d] AS bytes, len(s) = d AS last FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seqs)),
nodes AS MATERIALIZED (
  SELECT d, p, min(conv_id) AS node, count(*) AS n, any_value(up) AS up, (count(*) - 1) * coalesce(any_value(bytes), 0) AS own,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM prefixes GROUP BY d, p),
kids AS (SELECT d - 1 AS d, up AS p, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
told AS MATERIALIZED (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids USING (d, p)),
below AS (
  SELECT a AS d, p[1:a] AS p, sum(own) AS saved, count(*) FILTER (k = 0) AS leaves
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM told) GROUP BY ALL)
SELECT t.node AS conv_id, t.d::BIGINT AS depth, u.node AS parent_conv_id, t.n AS n_convs, t.k AS n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, t.ends_sha256
FROM told t JOIN below USING (d, p) LEFT JOIN told u ON u.d = t.d - 1 AND u.p = t.up
"""


def op12_lexical_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 best documents of every benchmark item, by block-max pruning over an index of all documents."""
    from loomshed.llm.common import drop_path, scratch
    from loomshed.llm.lexical import search, write_index

    path = scratch(spark, "lexical")
    found = search(write_index(table(spark, sf, "documents"), path), table(spark, sf, "benchmark"), 50)
    drop_path(spark, path)
    return found


OP12_SQL = r"""
WITH held AS MATERIALIZED (
  SELECT r, doc_id, w, count(*) AS tf FROM (
    SELECT row_number() OVER () AS r, doc_id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w
    FROM documents) GROUP BY ALL),
docs AS MATERIALIZED (SELECT r, sum(tf)::BIGINT AS n FROM held GROUP BY r),
corpus AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS total FROM docs),
asked AS MATERIALIZED (
  SELECT DISTINCT q, item_id, w FROM (
    SELECT row_number() OVER () AS q, item_id,
      unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w
    FROM benchmark)),
weights AS (
  SELECT w, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS weight
  FROM (SELECT w, count(*) AS df FROM held GROUP BY w), corpus),
shares AS (
  SELECT h.r, doc_id, h.w, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // total)) AS share
  FROM held h JOIN docs USING (r), corpus WHERE h.w IN (SELECT w FROM asked)),
scores AS (
  SELECT q, item_id, r, doc_id, sum(weight * share)::BIGINT AS score
  FROM asked a JOIN weights USING (w) JOIN shares s ON s.w = a.w GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) <= 50
"""


def op13_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    """Encode every document by the table of last tokens, and decode it."""
    import public_tokenizers
    from loomshed.llm.pieces import encode_documents, read_model

    model = read_model(spark, public_tokenizers.path(MODEL_FILE))
    return encode_documents(table(spark, sf, "documents"), model, keep=False).drop("token_ids", "decoded_text")


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """corpus_pipeline.py's run."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    "op1_url_reputation": (op1_url_reputation, OP1_SQL),
    "op2_warc": (op2_warc, OP2_SQL),
    "op3_media_chunks": (op3_media_chunks, None),
    "op4_bpe": (op4_bpe, None),
    "op5_top_k": (op5_top_k, OP5_SQL),
    "op6_training_order": (op6_training_order, None),
    "op7_curriculum": (op7_curriculum, OP7_SQL),
    "op8_near_duplicates": (op8_near_duplicates, OP8_SQL),
    "op9_toxicity": (op9_toxicity, None),
    "op10_pii": (op10_pii, None),
    "op11_conversation_trie": (op11_conversation_trie, OP11_SQL),
    "op12_lexical_search": (op12_lexical_search, OP12_SQL),
    "op13_sentencepiece": (op13_sentencepiece, None),
    "pipeline": (pipeline, None),
}


def queries() -> dict:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
