"""The numbered queries: given tables mapped to the operators' records, results mapped back.

Documents stand for listings: ``doc_id`` is the listing's ``id`` and ``text`` its ``description``.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lotwise.llm import balltree, bestfit, bpe, linededup, linequality, lmscore, neighbours, ngramjoin, packing
from lotwise.llm import repeats, secrets, spelling, topk
from lotwise.session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Bytes after which a batch for a Python worker is closed.
BATCH_BYTES = 4 << 20


def prepared(spark: SparkSession) -> SparkSession:
    """Rows of whole texts, id lists and blocks are wide: a Python worker gets fewer of them at once, by number and bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return prepare(spark)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: build(prepared(spark), sf_dir)
        if sql:
            ORACLES[name] = sql
        return build

    return register


PACKING = packing.Limits(max_tokens=4096, max_segments=64, max_loss_tokens=4096)


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def as_listings(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").alias("id"), F.col("text").alias("description"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_listings(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("op1_bpe_round_trip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_descriptions(listings(spark, sf_dir), word_vocabulary())
    decoded = bpe.decode_descriptions(encoded, word_vocabulary())
    return decoded.select(
        F.col("id").alias("doc_id"),
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("description").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op2_suffix_repeats")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = repeats.remove_repeats(listings(spark, sf_dir), width=200)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return cleaned.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@F.arrow_udf(LongType())
def ids_crc32(lists: pa.Array) -> pa.Array:
    ids, ends = lists.values.to_numpy().astype("<u4"), lists.offsets.to_numpy()
    return pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64())


@query("op3_vector_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode_descriptions(listings(spark, sf_dir), word_vocabulary())
    ended = encoded.withColumn("token_ids", F.concat("token_ids", F.array(F.lit(2))))
    pieces = packing.pack_listings(ended, PACKING)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", "length", ids_crc32("token_ids").alias("ids_crc32"),
        F.col("total_tokens").alias("doc_tokens"), "sequence_id", "offset",
    )


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(listings(spark, sf_dir))
    base = [rule.kind for rule in secrets.BASE_RULES]

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda span: span["kind"] == kind)).cast("long")

    return found.select(
        F.col("id").alias("doc_id"),
        *[number(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(secrets.spans_text(F.col("spans"), base).cast("binary"), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _usable(vector: str, zero: bool) -> str:
    """Whether a vector takes part, in SQL."""
    finite = f"len(list_filter({vector}, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    some = "" if zero else f" AND len(list_filter({vector}, lambda x: x <> 0)) > 0"
    return f"vec_id IS NOT NULL AND len({vector}) > 0 AND {finite}{some}"


TOP_PRODUCTS = f"""WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(64 * x)) AS e FROM embeddings
    WHERE {_usable('embedding', True)}),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c
    ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

NEAREST = f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE {_usable('embedding', False)}),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.e, c.e) AS score FROM v q JOIN v c
    ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM s)
  SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""

NEAR_COPIES = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w FROM documents),
  g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(
    range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' '))) END AS g FROM w),
  x AS (SELECT doc_id, len(g) AS n, unnest(g) AS shingle FROM g),
  pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM x a JOIN x b
    ON a.shingle = b.shingle AND a.doc_id <> b.doc_id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n GROUP BY ALL),
  links AS (SELECT a, b FROM pairs WHERE 100 * common >= 85 * (na + nb - common)),
  reached AS (SELECT doc_id AS root, doc_id AS node FROM g UNION SELECT root, b FROM reached JOIN links ON node = a)
  SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, min(node) AS component_id FROM g JOIN reached ON root = g.doc_id
  GROUP BY g.doc_id, len(g.g)"""


@query("op4_exact_top_products", TOP_PRODUCTS)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = topk.scaled(vectors(spark, sf_dir))
    return topk.top_products(whole.filter(F.col("vec_id") % 20 == 0), whole, k=20)


@query("op5_nearest_neighbours", NEAREST)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = vectors(spark, sf_dir)
    return neighbours.nearest(given.filter(F.col("vec_id") % 100 == 0), given, k=10)


def held_out(id_: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(id_.cast("string").cast("binary")) % 4 == 2


def quality_model(spark: SparkSession, texts: DataFrame, sf_dir: str) -> linequality.QualityModel:
    """The model learned from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("id"), "quality")
    return linequality.fit(texts, labels.filter(~held_out(F.col("id"))))


@query("op7_line_field_quality")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = listings(spark, sf_dir)
    scored = quality_model(spark, texts, sf_dir).score(texts)
    return scored.select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        (F.col("score") >= linequality.DIVIDE).cast("int").alias("predicted"),
    )


@query("op9_partenum_join", NEAR_COPIES)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngramjoin.near_copies(listings(spark, sf_dir), percent=85, width=4)
    return found.select(
        F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id")
    )


@query("op8_fuzzy_lines")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.remove_near_lines(listings(spark, sf_dir))
    return cleaned.select(
        F.col("id").alias("doc_id"),
        F.col("removed_lines").cast("long").alias("n_removed"),
        F.length("description").cast("long").alias("n_chars_kept"),
        F.sha2(F.col("description").cast("binary"), 256).alias("kept_sha256"),
    )


@query("op6_cross_entropy_difference")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = listings(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("id"), F.lit(True).alias("in_target")).distinct()
    # Labels grow with the documents: the plan is that of two large sides at every size.
    marked = texts.join(good.hint("merge"), "id", "left")
    return lmscore.fit(marked).score(marked).withColumnRenamed("id", "doc_id")


RANKED = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
  c AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
  i AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
  q AS (SELECT item_id, t, count(*) AS r FROM i GROUP BY ALL),
  p AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM d),
  f AS (SELECT doc_id, n, t, count(*) AS tf FROM p WHERE t IN (SELECT t FROM q) GROUP BY ALL),
  w AS (SELECT t, CAST(floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY t, c.n),
  s AS (SELECT item_id, doc_id, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * f.n * c.n) // c.l)))) AS BIGINT) AS score
    FROM q JOIN f USING (t) JOIN w USING (t), c GROUP BY ALL),
  o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
  SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10"""

#: The checksum is worked out from its polynomial; the table of 256 steps comes from the rule.
VARIANTS = r"""WITH RECURSIVE steps AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce([b] || range(8),
    lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM range(256) r(b))),
  o AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS w FROM documents),
  runs AS (SELECT doc_id, w, count(*) AS c FROM o GROUP BY ALL),
  h AS (SELECT w, c, xor(list_reduce([4294967295] || list_transform(flatten(list_transform(string_split(
      coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
        ELSE [CAST(192 + unicode(x) // 64 AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END)), lambda x: x),
    lambda a, b: xor(a // 256, steps.t[xor(a % 256, b) + 1])), 4294967295) AS h FROM runs, steps),
  m AS (SELECT CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, c FROM h),
  v AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM m WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
  cut AS (SELECT word, n, k, word[1:k - 1] || word[k + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v)),
  near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.rest = b.word),
  best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS other_n FROM near GROUP BY word),
  forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * v.n THEN other END AS form,
    CASE WHEN other_n >= 2 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
  onward AS (SELECT word, word AS root FROM forms UNION ALL SELECT o.word, f.form FROM onward o JOIN forms f ON o.root = f.word WHERE f.form IS NOT NULL),
  last AS (SELECT o.word, o.root FROM onward o JOIN forms f ON o.root = f.word WHERE f.form IS NULL)
  SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms JOIN last USING (word)"""


@query("op11_ball_tree_search", RANKED)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    searches = items.select(F.col("item_id").alias("search_id"), "text")
    found = balltree.rank_listings(listings(spark, sf_dir), searches, k=10)
    return found.select(F.col("search_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def misspelt(words: DataFrame) -> DataFrame:
    """Words with one letter taken out where their checksum says so."""
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word")).cast("binary"))
    place = (h % F.length("word")).cast("int")
    taken = F.concat(F.substring("word", F.lit(1), place), F.substring(F.col("word"), place + 2, F.length("word")))
    return words.select("id", F.when(h % 97 == 0, taken).otherwise(F.col("word")).alias("word"))


@query("op12_reduced_alphabet_variants", VARIANTS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = misspelt(spelling.description_words(listings(spark, sf_dir)))
    found = spelling.spelling_groups(spelling.vocabulary(words, least_length=5, least_count=3), times=2)
    return found.select("word", "form", "root", "n", "n_near", "form_n")


@query("op13_certified_best_fit")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bestfit.cut_descriptions(listings(spark, sf_dir), byte_vocabulary(), max_tokens=1024, ended_by=2)
    narrow = pieces.select(
        F.col("id").alias("doc_id"), "piece", "start", "length", ids_crc32("token_ids").alias("ids_crc32")
    )
    packed = bestfit.pack_best_fit(narrow, max_tokens=1024)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "certified")
