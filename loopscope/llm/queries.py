"""The registered query of each training-data operator, with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, divergence, jaccard, langid, merkle, mixing, neighbours, phrases, pieces, quality, resampling, toxicity, url_filter
from .shared import documents, fold

#: The rules of the pages query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents: every document with its source's size and target and the words taken of it. Edge cases as in the operator."""
    out = mixing.mix(documents(spark, sf_dir, "doc_id", "text", "source"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op2_hash_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth one. Edge cases as in the operator."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours.nearest(v, v.where("vec_id % 100 = 0"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from four fifths of the labelled ones. Edge cases as in the operator."""
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = langid.train(docs.where(fold("doc_id", 5) != 0))
    out = langid.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), "cross_entropy", "rejected")


def op4_merkle_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness to each other and to the next document's. Edge cases as in the operator."""
    return merkle.compare_with_edits(documents(spark, sf_dir, "doc_id", "text"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's set size, component and number of links. Edge cases as in the operator."""
    return jaccard.jaccard_join(documents(spark, sf_dir, "doc_id", "text"))[0]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict by four rules. Edge cases as in the operator."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score, learned from three quarters of the labelled ones. Edge cases as in the operator."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 4) != 2)
    out = quality.scored(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from two thirds of the labelled ones. Edge cases as in the operator."""
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), fold("doc_id", 3) != 1)
    out = toxicity.tag(docs, model).withColumn("score", F.col("toxicity"))
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's pieces and of the text that they decode to. Edge cases as in the operator."""
    return pieces.digests(documents(spark, sf_dir, "doc_id", "text"), tokenizer_file("piece_bpe_32k.model"))


def op10_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, lengths and checksums of every document's ids, read back from the files they were written to. Edge cases as in the operator."""
    return bitplanes.read(spark, bitplanes.write(documents(spark, sf_dir, "doc_id", "text"), tokenizer_file("word_bpe_49k.json"), 2))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with 20 words or more, drawn towards the benchmark; every document with its weight, score and rank."""
    out = resampling.resample(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language lies from its others, and the 200 terms most its own."""
    return divergence.audit(documents(spark, sf_dir, "text", "lang", "source"))


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document lie in runs of ten that the benchmark has too, and in which of its items."""
    return phrases.contamination(documents(spark, sf_dir, "doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_mix_to_weights, op2_hash_prefix_forest, op3_language_id, op4_merkle_fingerprint, op5_ngram_jaccard, op6_url_filters, op7_quality, op8_sentencepiece, op9_toxicity, op10_token_binary, op11_importance_resampling, op12_source_divergence, op13_benchmark_decontamination)}

LOWERED = f"translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}')"
#: Words of letters and digits, and letters alone, as the operators cut them.
ALNUM, LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"

#: Words of the 5-word shingles: everything but white space.
SPACED = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {
    "op5_ngram_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{SPACED}') AS l FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) >= 5 THEN list_transform(range(1, len(l) - 3), lambda i: array_to_string(l[i : i + 4], ' ')) WHEN len(l) > 0 THEN [array_to_string(l, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
one AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
link AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a),
many AS (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a),
sets AS (SELECT doc_id, list(g ORDER BY g) AS gs FROM s GROUP BY doc_id),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY gs) AS class_id FROM sets)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(class_id, d.doc_id) AS class_id, component_id, coalesce(n_links, 0) AS n_links FROM d LEFT JOIN n USING (doc_id) JOIN least USING (doc_id) LEFT JOIN many USING (doc_id) LEFT JOIN class USING (doc_id)
""",
    "op13_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{ALNUM}') AS l FROM documents),
i AS (SELECT item_id, regexp_extract_all({LOWERED}, '{ALNUM}') AS l FROM benchmark),
test AS (SELECT DISTINCT item_id, l[k : k + 9] AS t FROM (SELECT item_id, l, unnest(range(1, greatest(len(l) - 9, 1) + 1)) AS k FROM i WHERE len(l) > 0)),
sizes AS (SELECT DISTINCT len(t) AS size FROM test),
runs AS (SELECT doc_id, k, size, l[k : k + size - 1] AS t FROM (SELECT doc_id, l, size, unnest(range(1, len(l) - size + 2)) AS k FROM d, sizes)),
met AS (SELECT doc_id, k, size, item_id FROM runs JOIN test USING (t)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(k, k + size)) AS place FROM met) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id)
SELECT d.doc_id, len(l) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(own.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)
""",
    "op12_source_divergence": f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWERED}, '{LETTERS}') AS l FROM documents),
w AS (SELECT doc_id, lang, source, unnest(l) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(total) AS all_ FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
own AS (SELECT lang, source, sum(n) AS own FROM cnt GROUP BY ALL),
full_ AS (SELECT lang, source, term, total, coalesce(n, 0) AS n, coalesce(own, 0) AS own, v, all_ FROM grp JOIN kept USING (lang) JOIN langs USING (lang) LEFT JOIN cnt USING (lang, source, term) LEFT JOIN own USING (lang, source)),
p AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (own + v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (total + 1) // (all_ + v))::BIGINT AS q FROM full_),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
parts AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0)::BIGINT AS value FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source LEFT JOIN pairs ON pairs.lang = g.lang AND pairs.source = g.source AND pairs.item = h.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts QUALIFY part = 'pair' OR rank <= 200
""",
    "op11_importance_resampling": f"""
WITH RECURSIVE steps AS (SELECT range AS b, range AS v, 0 AS k FROM range(256) UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{ALNUM}') AS l FROM documents),
m AS (SELECT regexp_extract_all({LOWERED}, '{ALNUM}') AS l FROM benchmark),
df AS (SELECT doc_id, unnest(l || list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS f FROM d),
mf AS (SELECT unnest(l || list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1])) AS f FROM m),
kinds AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM df UNION SELECT f FROM mf)),
bytes AS (SELECT f, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS x FROM kinds),
bucket AS (SELECT f, xor(list_reduce(x, lambda a, y: xor(t[(xor(a, y) & 255) + 1], a >> 8), 4294967295), 4294967295) % 10000 AS k FROM bytes, crc),
s AS (SELECT k, count(*) AS n FROM df JOIN bucket USING (f) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM mf JOIN bucket USING (f) GROUP BY k),
both_ AS (SELECT r.range AS k, coalesce(s.n, 0)::DOUBLE AS s, coalesce(t.n, 0)::DOUBLE AS t, (SELECT count(*) FROM df)::DOUBLE AS all_s, (SELECT count(*) FROM mf)::DOUBLE AS all_t FROM range(10000) r LEFT JOIN s ON s.k = r.range LEFT JOIN t ON t.k = r.range),
gains AS (SELECT k, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS gain FROM both_),
sums AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS g FROM df JOIN bucket USING (f) JOIN gains USING (k) GROUP BY doc_id),
w AS (SELECT doc_id, len(l) AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (g - (g % n + n) % n) // n ELSE 0 END AS weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT AS h FROM d LEFT JOIN sums USING (doc_id)),
c AS (SELECT doc_id, n_words, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 25 * count(*) OVER () // 100 AS most FROM c WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank, n_words FROM c LEFT JOIN r USING (doc_id)
""",
    "op6_url_filters": f"""
WITH u AS (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, translate(raw, '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(rhost, rpath, verdict) AS (VALUES {", ".join(str(r) for r in RULES)}),
fit AS (SELECT page_id, host, path, rhost || rpath AS rule, r.verdict FROM p LEFT JOIN rules r ON host <> '' AND (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1
""",
}
