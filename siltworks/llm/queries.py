"""The queries of this subpackage: each operator over its whole table, and where SQL can say the same, its twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltworks.llm import chat, collocations, divergence, genetic_packing, lm, mixing, ngram_join, nn_descent, packing, quality, rules, secrets, warc
from siltworks.llm.common import crc32_mod, stored, table
from siltworks.plans.scratch import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# operator 1

_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, {k + 1}, 5))::INTEGER >> {s}) & 31), 1)"
    for k in range(0, 40, 5) for s in (15, 10, 5, 0)
)


@query("op1_warc", f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p),
     f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
""")
def op1_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(warc.records(table(spark, sf, "pages"), "page_id", "html", "url", revisit_bytes=0), path, level=4)
    back = warc.read_archive(spark, path, payloads=False, verify=True)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


# operator 2

QUALITY_THRESHOLD = 0.7


@query("op2_quality")
def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    held_out = crc32_mod("doc_id", 4) == 2
    scored, _ = quality.classify(table(spark, sf, "documents"), table(spark, sf, "labels").where(~held_out))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


# operator 3


@query("op3_secrets")
def op3_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(table(spark, sf, "documents").select("doc_id", "text")).withColumn("_base", F.filter("secrets", lambda s: s["kind"] != "random"))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(kind) for kind, *_ in secrets.BASE], F.sha2(secrets.listing(F.col("_base")), 256).alias("base_sha256"), secrets.listing(F.col("secrets")).alias("spans"))


# operator 4


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(packing.encode_texts(docs, "doc_id", "text"), tokens=1024)
    return pieces.select(
        F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )


@query("op4_packing")
def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packed(table(spark, sf, "documents"))


# operator 5


@query("op5_ngram_join", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), g AS (SELECT doc_id, unnest(s) AS gram FROM s),
shared AS (SELECT gram FROM g GROUP BY gram HAVING count(*) > 1),
h AS (SELECT g.* FROM g JOIN shared USING (gram)),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM h a JOIN h b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 80 * (len(x.s) + len(y.s) - n)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS seen FROM s UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen)
SELECT s.doc_id, len(s.s) AS n_shingles, min(r.seen) AS component_id FROM s JOIN reach r ON r.node = s.doc_id GROUP BY 1, 2
""")
def op5_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, sf, "documents")).drop("text_hash")


# operator 6


@query("op6_nn_descent", """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
), u AS (
  SELECT vec_id, e FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON c.node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
""")
def op6_nn_descent(spark: SparkSession, sf: str) -> DataFrame:
    return nn_descent.near_vectors(table(spark, sf, "embeddings"))


# operator 7


def mixed(docs: DataFrame) -> DataFrame:
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    return mixing.mix(sized.withColumn("_sources", F.array("source")), "size", "_sources")


@query("op7_mixing")
def op7_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixed(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# operator 8


@query("op8_rules")
def op8_rules(spark: SparkSession, sf: str) -> DataFrame:
    stats = stored(rules.statistics(table(spark, sf, "documents").select("doc_id", "text")), "text-statistics")
    labels = table(spark, sf, "labels").groupBy("doc_id").agg(F.min("quality").alias("label"))
    verdict = rules.learn(stats.join(labels, "doc_id")).keeps()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return stats.select(*base, failed.alias("base_failed"), (~failed & verdict).alias("kept"))


# operator 9


@query("op9_lm")
def op9_lm(spark: SparkSession, sf: str) -> DataFrame:
    return lm.score(table(spark, sf, "documents"), crc32_mod("doc_id", 7) == 2)


# operator 10

CHAT_TEST = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@query("op10_chat", r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|role|><|text|><|end|>') + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'))
           + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id
""")
def op10_chat(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(CHAT_TEST, "conv_id long, turn long, role string, text string"))
    return chat.read_back(chat.format_conversations(rows)).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


# operator 11


@query("op11_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
o AS (
  SELECT i, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT o.lang, source, term, count(*) AS n FROM o JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(total)::HUGEINT AS n FROM kept GROUP BY 1),
s AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, (1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (coalesce(s.n, 0) + 2 * v.v))::BIGINT AS p,
         (1 + (1000000000::HUGEINT * (k.total + 2)) // (v.n + 2 * v.v))::BIGINT AS q
  FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
every AS (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM every QUALIFY part = 'pair' OR rank <= 10
""")
def op11_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return divergence.divergence(table(spark, sf, "documents"))


# operator 12


@query("op12_collocations", r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY 1),
o AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS parts, count(*) AS f FROM o GROUP BY lang, k, phrase HAVING count(*) >= 100),
s AS (SELECT DISTINCT lang, f, unnest([array_to_string(parts[1:k - 1], ' '), array_to_string(parts[2:k], ' ')]) AS phrase FROM f WHERE k > 2),
c AS (SELECT * FROM f WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM s WHERE s.lang = f.lang AND s.phrase = f.phrase AND s.f = f.f)),
x AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f) AS score, g.cut
  FROM c JOIN range(1, 5) g(cut) ON g.cut < c.k JOIN n ON n.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.parts[1:g.cut], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.parts[g.cut + 1:c.k], ' ')
), b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b QUALIFY rank <= 2000
""")
def op12_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(table(spark, sf, "documents"))


# operator 13


@query("op13_genetic_packing")
def op13_genetic_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = genetic_packing.pack(table(spark, sf, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
