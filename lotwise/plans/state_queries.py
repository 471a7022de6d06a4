"""Documents, URL state, listing upserts, runs and health over the given tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions import quality
from lotwise.operators import crawl, documents, upsert, url_state
from lotwise.plans.catalogue import query
from lotwise.plans.relations import (
    ATTEMPTS,
    CLOCK,
    CRAWL_CLOCK,
    CRAWL_RUNS,
    DOCUMENTS_LOG,
    FETCH_LOG,
    FETCH_LOG_OF_SOURCES,
    LISTINGS,
    clock,
    given,
    listings,
    plain,
    relation,
    stamp,
    stamp_sql,
    table,
)
from lotwise.schemas import CONTENT_FIELDS, CONTENT_NAMES, TRACKED_FIELDS

D = given(docs=DOCUMENTS_LOG)
EXTENSION_SQL = (
    "CASE lower(trim(split_part(mime_type, ';', 1))) "
    + " ".join(f"WHEN '{mime}' THEN '{ending}'" for mime, ending in documents.EXTENSIONS.items())
    + " ELSE '.bin' END"
)
KEY_SQL = f"source_id || '/' || strftime(fetched_at, '%Y/%m/%d') || '/' || sha256(text) || {EXTENSION_SQL}"


def raw_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = relation(spark, sf_dir, DOCUMENTS_LOG)
    return docs.withColumn("content", F.col("text").cast("binary")).withColumn(
        "fetched_at", F.col("fetched_at").cast("timestamp")
    )


# --- documents ------------------------------------------------------------


@query(
    "a2_scan_archive",
    f"""{D} SELECT id, url, {stamp_sql('fetched_at')} FROM docs WHERE source_id = 'en'
    ORDER BY docs.fetched_at DESC LIMIT 100""",
)
def scan_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = documents.with_archive_key(raw_documents(spark, sf_dir))
    return documents.scan_archive(archive, "en", 100).select("id", "url", stamp("fetched_at"))


@query(
    "a3_new_for_archive",
    f"""{D}, keyed AS (SELECT *, {KEY_SQL} AS storage_key FROM docs)
    SELECT storage_key, min(id) AS id FROM keyed WHERE storage_key NOT IN
    (SELECT storage_key FROM keyed WHERE id % 3 = 0) GROUP BY storage_key""",
)
def new_for_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw_documents(spark, sf_dir)
    archive = documents.with_archive_key(docs.filter("id % 3 = 0"))
    return documents.new_for_archive(archive, docs).select("storage_key", "id")


@query("a4_mime_extension", f"{D} SELECT id, {EXTENSION_SQL} AS ending FROM docs")
def mime_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = relation(spark, sf_dir, DOCUMENTS_LOG)
    return docs.select("id", documents.mime_extension(F.col("mime_type")).alias("ending"))


@query("a5_content_sha256", "SELECT doc_id AS id, sha256(text) AS sha256 FROM documents")
def content_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = documents.content_sha256(F.col("content")).alias("sha256")
    return raw_documents(spark, sf_dir).select("id", hashed)


@query(
    "a6_canonical_sha256",
    r"""SELECT doc_id AS id, sha256(text || ' Visitor Count:</span><span>' || '</span> 123'
    || '\"children\":') AS sha256 FROM documents""",
)
def canonical_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with a counter in the page and one in its payload; both must vanish."""
    counter = (F.col("doc_id") + 1_000_000).cast("string")
    page = F.concat(
        F.col("text"), F.lit(" Visitor Count:</span><span>"), counter, F.lit("</span> 123"),
        F.lit('\\"children\\":'), counter, F.lit(']]}],[\\"$\\",\\"div'),
    )
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("id"), documents.canonical_sha256(page.cast("binary")).alias("sha256")
    )


@query(
    "a7_archive_contains",
    f"""{D} SELECT id FROM docs WHERE id % 2 = 1 AND (source_id, sha256(text)) IN
    (SELECT (source_id, sha256(text)) FROM docs WHERE id % 2 = 0)""",
)
def archive_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.with_archive_key(raw_documents(spark, sf_dir))
    return documents.contains_hash(docs.filter("id % 2 = 0"), docs.filter("id % 2 = 1")).select("id")


@query("a7_archive_count", f"{D} SELECT source_id, count(*) AS documents FROM docs GROUP BY 1")
def archive_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.count_per_source(relation(spark, sf_dir, DOCUMENTS_LOG))


@query(
    "a8_provenance",
    f"""{D} SELECT id, source_id, url, mime_type, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes,
    {KEY_SQL} AS storage_key FROM docs""",
)
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.provenance(raw_documents(spark, sf_dir)).drop("text", "fetched_at")


@query(
    "a17_fetch_outcome",
    """SELECT event_id AS id, CASE WHEN user_id % 10 = 0 THEN 'blocked_by_robots' WHEN event_type = 'signup' THEN 'not_modified'
    WHEN event_type = 'error' OR (event_type = 'click' AND user_id % 10 = 1) THEN 'failed'
    WHEN floor(value / 40) = user_id % 3 THEN 'unchanged' ELSE 'new' END AS outcome FROM events""",
)
def fetch_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id")
    http = F.when(kind == "signup", 304).when(kind == "error", 503).when(
        (kind == "click") & (user % 10 == 1), F.lit(None).cast("int")
    ).otherwise(200)
    found = url_state.fetch_outcome(
        user % 10 != 0, http, (user % 3).cast("string"), F.floor(F.col("value") / 40).cast("string")
    )
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), found.alias("outcome"))


@query("d7_documents_per_source", f"{D} SELECT source_id, count(*) AS documents FROM docs GROUP BY 1")
def documents_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.count_per_source(raw_documents(spark, sf_dir))


@query("d15_many_versions", f"{D} SELECT url, count(*) AS versions FROM docs GROUP BY 1 HAVING count(*) > 1")
def many_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.many_versions(relation(spark, sf_dir, DOCUMENTS_LOG))


@query(
    "d16_first_and_last",
    f"""{D}, e AS (SELECT url, count(*) AS versions, min(fetched_at) AS first_at, max(fetched_at) AS last_at,
    arg_min(text, fetched_at) AS a, arg_max(text, fetched_at) AS b FROM docs GROUP BY 1 HAVING count(*) > 1)
    SELECT url, versions, {stamp_sql('first_at')}, {stamp_sql('last_at')}, length(a) AS first_chars,
    length(b) AS last_chars, a = b AS identical FROM e""",
)
def first_and_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = relation(spark, sf_dir, DOCUMENTS_LOG).withColumnRenamed("text", "content")
    ends = documents.first_and_last(docs)
    return ends.withColumns({"first_at": stamp("first_at"), "last_at": stamp("last_at")})


@query(
    "f7_newest_documents",
    f"{D} SELECT id, url, {stamp_sql('fetched_at')} FROM docs ORDER BY docs.fetched_at DESC, id LIMIT 10",
)
def newest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = relation(spark, sf_dir, DOCUMENTS_LOG)
    return documents.recent(docs, "fetched_at", "id", 10).select("id", "url", stamp("fetched_at"))


@query(
    "f7_newest_runs",
    f"""{given(runs=CRAWL_RUNS)} SELECT source_id, run_id, CAST(discovered AS BIGINT) AS discovered FROM runs
    ORDER BY ran_at DESC, source_id LIMIT 8""",
)
def newest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = relation(spark, sf_dir, CRAWL_RUNS)
    return documents.recent(runs, "ran_at", "source_id", 8).select("source_id", "run_id", "discovered")


@query(
    "c4_stamp_documents",
    f"""{D}, kept AS (SELECT url, sha256(text) AS sha256, min(id) AS doc FROM docs WHERE id % 4 <> 0 GROUP BY ALL)
    SELECT id, doc AS source_document_id FROM docs LEFT JOIN kept ON kept.url = docs.url AND kept.sha256 = sha256(text)""",
)
def stamp_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents.with_archive_key(raw_documents(spark, sf_dir)).select("id", "url", "sha256")
    kept = docs.filter("id % 4 <> 0").groupBy("url", "sha256").agg(F.min("id").alias("id"))
    return documents.stamp_documents(docs, kept).select("id", "source_document_id")


# --- URL state ------------------------------------------------------------

FOLD = f"""{given(log=FETCH_LOG)},
 b AS (SELECT *, lag(content_hash) OVER (PARTITION BY url ORDER BY fetched_at, seq) AS prev,
   lag(fetched_at) OVER (PARTITION BY url ORDER BY fetched_at, seq) AS prev_at FROM log WHERE outcome = 'ok'),
 ch AS (SELECT *, content_hash IS DISTINCT FROM prev AS changed FROM b),
 ends AS (SELECT url, min((fetched_at, seq)) AS opened, max((fetched_at, seq)) FILTER (changed) AS turned,
   count(*) FILTER (changed) AS versions, arg_max(content_hash, (fetched_at, seq)) AS content_hash,
   arg_max(etag, (fetched_at, seq)) AS etag FROM ch GROUP BY url),
 state AS (SELECT e.url, e.content_hash, e.etag, min(l.fetched_at) AS first_seen_at, max(l.fetched_at) AS last_fetched_at,
   max(l.fetched_at) FILTER ((l.fetched_at, l.seq) = e.turned) AS last_changed_at, count(*) AS fetch_count,
   count(*) FILTER ((l.fetched_at, l.seq) > e.turned) AS unchanged_streak, e.versions
   FROM ends e JOIN log l ON l.url = e.url AND l.outcome IN ('ok', 'not_modified') AND (l.fetched_at, l.seq) >= e.opened
   GROUP BY ALL)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, FETCH_LOG)


@query(
    "e1_url_state",
    f"""{FOLD} SELECT url, content_hash, etag, {stamp_sql('first_seen_at')}, {stamp_sql('last_fetched_at')},
    {stamp_sql('last_changed_at')}, fetch_count, unchanged_streak, versions FROM state""",
)
def fold_url_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = url_state.fold_url_state(_log(spark, sf_dir)).drop("document")
    times = ("first_seen_at", "last_fetched_at", "last_changed_at")
    return state.withColumns({name: stamp(name) for name in times})


FOLD_OF_SOURCES = FOLD.replace(plain(FETCH_LOG), plain(FETCH_LOG_OF_SOURCES), 1) + """,
 told AS (SELECT url, arg_min(source_id, (fetched_at, seq)) AS source_id, arg_max(last_modified, (fetched_at, seq)) AS last_modified
   FROM ch GROUP BY url)"""


@query(
    "e1_url_state_of_sources",
    f"""{FOLD_OF_SOURCES} SELECT url, source_id, etag, last_modified, {stamp_sql('last_fetched_at')}, fetch_count
    FROM state JOIN told USING (url)""",
)
def fold_url_state_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = url_state.fold_url_state(relation(spark, sf_dir, FETCH_LOG_OF_SOURCES))
    return state.select("url", "source_id", "etag", "last_modified", stamp("last_fetched_at"), "fetch_count")


FOUND_OF_SOURCE = """SELECT 'https://x.test/property-detail/' || CAST(user_id AS VARCHAR(20)) || '/ab' AS url, min(event_id) AS position
 FROM {events} WHERE user_id % 3 = 1 GROUP BY user_id"""


@query(
    "c3_next_run_of_a_source",
    f"""{FOLD_OF_SOURCES}, found AS ({plain(FOUND_OF_SOURCE)}), known AS (SELECT url, last_fetched_at FROM state JOIN told USING (url)
    WHERE source_id = 's1') SELECT url, position, {stamp_sql('last_fetched_at')} FROM found LEFT JOIN known USING (url)
    ORDER BY known.last_fetched_at NULLS FIRST, position LIMIT 40""",
)
def next_run_of_a_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fetch log to the state of one source, and that to the URLs of its next run."""
    state = url_state.fold_url_state(relation(spark, sf_dir, FETCH_LOG_OF_SOURCES)).filter("source_id = 's1'")
    chosen = crawl.prioritise(relation(spark, sf_dir, FOUND_OF_SOURCE), state, 40)
    return chosen.select("url", "position", stamp("last_fetched_at"))


DOCS = f"""{FOLD},
 eras AS (SELECT *, sum(CAST(changed AS INTEGER)) OVER (PARTITION BY url ORDER BY fetched_at, seq) AS era FROM ch),
 kept AS (SELECT url, arg_min(document, (fetched_at, seq)) AS document, min(fetched_at) AS made, max(fetched_at) AS seen
   FROM eras GROUP BY url, era),
 d AS (SELECT url, document, min(made) AS fetched_at, max(seen) AS last_seen_at, count(*) AS times_published
   FROM kept GROUP BY url, document)"""


@query(
    "e6_documents",
    f"{DOCS} SELECT url, document, {stamp_sql('fetched_at')}, {stamp_sql('last_seen_at')}, times_published FROM d",
)
def fold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = url_state.fold_documents(_log(spark, sf_dir))
    return docs.withColumns({"fetched_at": stamp("fetched_at"), "last_seen_at": stamp("last_seen_at")})


@query("d7_count_urls", f"{FOLD} SELECT count(*) AS urls FROM state")
def count_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = _log(spark, sf_dir).filter("outcome = 'ok'")
    return bodies.agg(F.countDistinct("url").alias("urls"))


@query(
    "c5_state_with_document",
    f"""{DOCS} SELECT s.url, c.document, {stamp_sql('d.fetched_at', 'fetched_at')}, unchanged_streak FROM state s
    JOIN (SELECT url, arg_max(document, (fetched_at, seq)) AS document FROM ch WHERE changed GROUP BY url) c ON c.url = s.url
    LEFT JOIN d ON d.url = s.url AND d.document = c.document""",
)
def state_with_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    joined = documents.state_with_document(url_state.fold_url_state(log), url_state.fold_documents(log))
    return joined.select("url", "document", stamp("fetched_at"), "unchanged_streak")


DISCOVERED = "SELECT url, min(page_id) AS position FROM {pages} GROUP BY url"
KNOWN = """SELECT url, max(CAST(TIMESTAMP '2024-01-01 00:00:00' + (page_id * 7919 % 1000) * INTERVAL '1' MINUTE AS TIMESTAMP)) AS last_fetched_at
 FROM {pages} WHERE page_id % 3 = 0 GROUP BY url"""
P = given(found=DISCOVERED, known=KNOWN)


def _prioritised(name: str, limit: int | None) -> None:
    kept = "SELECT url FROM ranked" if limit is None else f"""SELECT url FROM ranked ORDER BY
      CASE WHEN (SELECT count(*) FROM found) <= {limit} THEN NULL ELSE last_fetched_at END ASC NULLS FIRST, position LIMIT {limit}"""

    @query(name, f"{P}, ranked AS (SELECT found.*, last_fetched_at FROM found LEFT JOIN known USING (url)) {kept}")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        found, known = relation(spark, sf_dir, DISCOVERED), relation(spark, sf_dir, KNOWN)
        return crawl.prioritise(found, known, limit).select("url")


_prioritised("c3_prioritise", 200)
_prioritised("c3_prioritise_everything", None)


@query("c10_unseen_urls", f"{P} SELECT url FROM found WHERE url NOT IN (SELECT url FROM known)")
def unseen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.split_seen(relation(spark, sf_dir, DISCOVERED), relation(spark, sf_dir, KNOWN))[0].select("url")


@query("c10_seen_urls", f"{P} SELECT url FROM found WHERE url IN (SELECT url FROM known)")
def seen_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.split_seen(relation(spark, sf_dir, DISCOVERED), relation(spark, sf_dir, KNOWN))[1].select("url")


# --- listing upsert -------------------------------------------------------


def _version(seq: int, where: str, **changed: str) -> str:
    columns = ", ".join(f"{changed[name]} AS {name}" if name in changed else name for name in CONTENT_NAMES)
    return (
        f"SELECT source_id, external_id, {columns}, CAST(CASE WHEN id % 11 = 0 THEN 0.40 ELSE confidence END AS DECIMAL(3,2)) "
        f"AS confidence, CAST({seq} AS BIGINT) AS seq, CAST(TIMESTAMP '2002-0{seq}-01 00:00:00' AS TIMESTAMP) AS seen_at "
        f"FROM l WHERE {where}"
    )


_CUT = "CASE WHEN id % 5 = 0 THEN CAST(reserve_price * 0.5 AS DECIMAL(18,2)) ELSE reserve_price END"
_STAYED = "CASE WHEN id % 4 = 0 THEN 'stayed' ELSE status END"
#: Three readings of the listings: a price cut, a stay with a new address, and the same again.
_READINGS = {1: "id % 4 <> 1", 2: "id % 6 = 0", 3: "id % 12 = 0"}
PARSED = f"""WITH l AS ({LISTINGS}) {_version(1, _READINGS[1], reserve_price=_CUT)}
 UNION ALL {_version(2, _READINGS[2], reserve_price=_CUT, status=_STAYED, address="upper(address)")}
 UNION ALL {_version(3, _READINGS[3], reserve_price=_CUT, status=_STAYED, address="upper(address)")}"""
STORED = f"SELECT * FROM ({LISTINGS}) AS l WHERE id % 3 <> 0"


def _text_sql(name: str, kind: T.DataType) -> str:
    if isinstance(kind, T.TimestampType):
        return f"strftime({name}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"
    return f"CAST({name} AS VARCHAR)"


def _quoted_sql(text: str) -> str:
    return f"""'"' || replace(replace({text}, '\\', '\\\\'), '"', '\\"') || '"'"""


HASH_SQL = (
    "sha256('{' || "
    + " || ',' || ".join(
        f"""'"{name}":' || coalesce({_quoted_sql(_text_sql(name, kind))}, 'null')"""
        for name, kind in sorted(CONTENT_FIELDS, key=lambda field: field[0])
    )
    + " || '}')"
)

MERGE = f"""{given(stored=STORED, parsed=PARSED)},
 line AS (SELECT source_id, external_id, {', '.join(CONTENT_NAMES)}, confidence, is_published, updated_at, CAST(0 AS BIGINT) AS seq,
    CAST(NULL AS TIMESTAMP) AS seen_at FROM stored
  UNION ALL SELECT source_id, external_id, {', '.join(CONTENT_NAMES)}, confidence, NULL, NULL, seq, seen_at FROM parsed),
 hashed AS (SELECT *, {HASH_SQL} AS h FROM line),
 acted AS (SELECT *, CASE WHEN seq = 0 THEN 'stored' WHEN lag(h) OVER w IS NULL THEN 'created' WHEN lag(h) OVER w = h THEN 'unchanged'
   ELSE 'updated' END AS action FROM hashed WINDOW w AS (PARTITION BY source_id, external_id ORDER BY seq)),
 eff AS (SELECT * FROM acted WHERE action <> 'unchanged')"""


def stored_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).filter("id % 3 <> 0")


def parsed_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings of ``PARSED`` from one scan: each listing is spread over the versions it has."""
    has = F.array_compact(F.array(*[F.when(F.expr(w), F.lit(n).cast("long")) for n, w in _READINGS.items()]))
    later = F.col("seq") > 1
    return (
        listings(spark, sf_dir)
        .withColumn("seq", F.explode(has))
        .select(
            "id", "source_id", "external_id",
            *[c for c in CONTENT_NAMES if c not in ("reserve_price", "status", "address")],
            F.expr(_CUT).alias("reserve_price"),
            F.when(later, F.expr(_STAYED)).otherwise(F.col("status")).alias("status"),
            F.when(later, F.upper("address")).otherwise(F.col("address")).alias("address"),
            F.expr("CAST(CASE WHEN id % 11 = 0 THEN 0.40 ELSE confidence END AS DECIMAL(3,2))").alias("confidence"),
            "seq",
            F.make_timestamp(F.lit(2002), F.col("seq").cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("seen_at"),
        )
        .drop("id")
    )


def _revisions(spark: SparkSession, sf_dir: str, tracked: Sequence[str] = TRACKED_FIELDS) -> DataFrame:
    """The busy listings are written first: with their size known, no table is shuffled to meet a list that is short or empty."""
    busy = upsert.known_busy_listings(parsed_listings(spark, sf_dir))
    return upsert.revisions(_actions(spark, sf_dir, busy), hot=busy, tracked=tracked)


def _actions(spark: SparkSession, sf_dir: str, busy: DataFrame | tuple[()] | None = None) -> DataFrame:
    if busy is None:
        busy = upsert.known_busy_listings(parsed_listings(spark, sf_dir))
    empty: dict[str, Column] = {
        "quality_flags": F.lit(None).cast("array<string>"),
        "raw_payload": F.lit(None).cast("string"),
    }
    stored = upsert.with_fingerprint(stored_listings(spark, sf_dir).withColumns(empty))
    parsed = parsed_listings(spark, sf_dir).withColumns(empty)
    return upsert.merge_listings(stored, parsed, hot=busy)


@query("e4_fingerprint", f"{given(listings=LISTINGS)} SELECT id, {HASH_SQL} AS content_hash FROM listings")
def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.with_fingerprint(listings(spark, sf_dir)).select("id", "content_hash")


@query("c6_listing_merge", f"{MERGE} SELECT source_id, external_id, seq, action FROM acted WHERE action <> 'stored'")
def listing_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = _actions(spark, sf_dir).filter("action <> 'stored'")
    return actions.select("source_id", "external_id", "seq", "action")


@query(
    "e2_upsert",
    f"""{MERGE}, verified AS (SELECT source_id, external_id, max(seen_at) AS last_at FROM line GROUP BY ALL)
    SELECT e.source_id, e.external_id, e.status, e.address, CAST(e.reserve_price AS DOUBLE) AS reserve_price, e.h AS content_hash,
    CASE WHEN action = 'stored' THEN is_published ELSE confidence >= 0.70 END AS is_published,
    {stamp_sql("CASE WHEN action = 'stored' THEN updated_at WHEN action = 'updated' THEN seen_at END", 'updated_at')},
    {stamp_sql("coalesce(last_at, (SELECT last_verified_at FROM stored s WHERE s.source_id = e.source_id AND s.external_id = e.external_id))", 'last_verified_at')}
    FROM (SELECT *, row_number() OVER (PARTITION BY source_id, external_id ORDER BY seq DESC) AS place FROM eff) e
    JOIN verified v ON v.source_id = e.source_id AND v.external_id = e.external_id WHERE place = 1""",
)
def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = upsert.snapshot(_actions(spark, sf_dir), ("status", "address", "reserve_price", "content_hash"))
    return merged.select(
        "source_id", "external_id", "status", "address", F.col("reserve_price").cast("double").alias("reserve_price"),
        "content_hash", "is_published", stamp("updated_at"), stamp("last_verified_at"),
    )


_KINDS = dict(CONTENT_FIELDS)
REVISED = f"""{MERGE}, told AS (SELECT source_id, external_id, seq, action, seen_at,
 {', '.join(f'{_text_sql(n, _KINDS[n])} AS new_{n}, lag({_text_sql(n, _KINDS[n])}) OVER w AS old_{n}' for n in TRACKED_FIELDS)}
 FROM eff WINDOW w AS (PARTITION BY source_id, external_id ORDER BY seq)),
 rev AS ({' UNION ALL '.join(
     f"SELECT source_id, external_id, seq, seen_at, '{n}' AS field_name, old_{n} AS old_value, new_{n} AS new_value "
     f"FROM told WHERE action = 'updated' AND old_{n} IS DISTINCT FROM new_{n}" for n in TRACKED_FIELDS)})"""


@query(
    "e3_revisions",
    f"{REVISED} SELECT source_id, external_id, seq, {stamp_sql('seen_at', 'changed_at')}, field_name, old_value, new_value FROM rev",
)
def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _revisions(spark, sf_dir)
    return history.withColumn("changed_at", stamp("changed_at")).drop("source_document_id")


@query(
    "e12_reserve_direction",
    f"""{REVISED} SELECT source_id, external_id, seq, CASE WHEN CAST(new_value AS DOUBLE) < CAST(old_value AS DOUBLE)
    THEN 'down' ELSE 'up' END AS direction FROM rev WHERE field_name = 'reserve_price'
    AND CAST(old_value AS DOUBLE) <> 0 AND CAST(new_value AS DOUBLE) <> 0""",
)
def reserve_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    moves = upsert.reserve_direction(_revisions(spark, sf_dir, ("reserve_price",)))
    return moves.select("source_id", "external_id", "seq", "direction")


@query(
    "c8_listing_revisions",
    f"""{REVISED} SELECT listings.id AS listing_id, title, seq, field_name, new_value FROM ({LISTINGS.replace('{', '').replace('}', '')}) listings
    JOIN rev ON rev.source_id = listings.source_id AND rev.external_id = listings.external_id""",
)
def listing_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _revisions(spark, sf_dir)
    known = listings(spark, sf_dir).select("id", "title", "source_id", "external_id")
    joined = upsert.revisions_of(known, history)
    return joined.select(F.col("id").alias("listing_id"), "title", "seq", "field_name", "new_value")


@query(
    "e5_publish_rule",
    f"{given(parsed=PARSED)} SELECT external_id, seq, confidence >= 0.70 AS publish FROM parsed",
)
def publish_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = parsed_listings(spark, sf_dir)
    return parsed.select("external_id", "seq", quality.is_publishable(F.col("confidence")).alias("publish"))


@query(
    "e10_parse_status",
    f"""{given(listings=LISTINGS)} SELECT id, CASE WHEN auction_start_at IS NULL THEN 'unscheduled'
    WHEN TIMESTAMP '{CLOCK}' < auction_start_at THEN 'upcoming'
    WHEN auction_end_at IS NOT NULL AND TIMESTAMP '{CLOCK}' <= auction_end_at THEN 'live' ELSE 'closed' END AS parsed_status FROM listings""",
)
def parse_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = quality.listing_status(F.col("auction_start_at"), F.col("auction_end_at"), clock())
    return listings(spark, sf_dir).select("id", status.alias("parsed_status"))


@query(
    "a15_sync_missing",
    f"""{given(listings=LISTINGS)} SELECT id, source_id, external_id, CAST(NULL AS BIGINT) AS source_document_id FROM listings
    WHERE id % 3 = 0""",
)
def sync_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = listings(spark, sf_dir).withColumn("source_document_id", F.col("id"))
    moved = upsert.sync_missing(local, stored_listings(spark, sf_dir), ["source_id", "external_id"])
    return moved.select("id", "source_id", "external_id", "source_document_id")


@query(
    "a15_sync_counts",
    f"""{given(listings=LISTINGS)} SELECT 'listings' AS table_name, count(*) AS local_rows,
    count(*) FILTER (id % 3 <> 0) AS remote_rows FROM listings""",
)
def sync_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return upsert.sync_counts(listings(spark, sf_dir), stored_listings(spark, sf_dir), "listings")


LOCAL_REVISIONS = """SELECT o_orderkey AS listing_id, l_linenumber AS changed_at, 'reserve_price' AS field_name,
  CAST(l_partkey AS VARCHAR(20)) AS old_value, CAST(l_suppkey AS VARCHAR(20)) AS new_value, l_orderkey AS source_document_id
  FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""


@query(
    "a15_sync_revisions",
    f"""{given(r=LOCAL_REVISIONS)} SELECT listing_id, changed_at, field_name, old_value, new_value,
    CAST(NULL AS BIGINT) AS source_document_id FROM r WHERE (listing_id + changed_at) % 4 <> 0""",
)
def sync_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the history, spread over all listings, is on the other side already."""
    local = relation(spark, sf_dir, LOCAL_REVISIONS)
    remote = local.filter((F.col("listing_id") + F.col("changed_at")) % 4 == 0)
    return upsert.sync_missing(local, remote, ["listing_id", "changed_at", "field_name"])


@query(
    "a15_sync_counts_of_both",
    f"""{given(listings=LISTINGS, r=LOCAL_REVISIONS)} SELECT 'listings' AS table_name, count(*) AS local_rows,
    count(*) FILTER (id % 3 <> 0) AS remote_rows FROM listings UNION ALL SELECT 'listing_revisions', count(*),
    count(*) FILTER ((listing_id + changed_at) % 4 = 0) FROM r""",
)
def sync_counts_of_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = relation(spark, sf_dir, LOCAL_REVISIONS)
    there = history.filter((F.col("listing_id") + F.col("changed_at")) % 4 == 0)
    listing_rows = upsert.sync_counts(listings(spark, sf_dir), stored_listings(spark, sf_dir), "listings")
    return listing_rows.unionByName(upsert.sync_counts(history, there, "listing_revisions"))


@query(
    "c9_existing_rows_win",
    f"""{given(listings=LISTINGS)}, here AS (SELECT external_id FROM listings WHERE id % 3 <> 0),
    remote AS (SELECT external_id, 'remote' AS side FROM here)
    SELECT external_id, side FROM remote UNION ALL SELECT external_id, 'local' FROM listings WHERE external_id NOT IN (SELECT external_id FROM here)""",
)
def existing_rows_win(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The remote table after the copy."""
    remote = stored_listings(spark, sf_dir)
    fresh = upsert.sync_missing(listings(spark, sf_dir), remote, ["source_id", "external_id"])
    after = remote.select("external_id", F.lit("remote").alias("side"))
    return after.unionByName(fresh.select("external_id", F.lit("local").alias("side")))


# --- runs and health ------------------------------------------------------

READ = "outcome = 'new'"
REPORTS = f"""{given(attempts=ATTEMPTS)}, reports AS (SELECT run_id, source_id, count(*) AS discovered,
 count(*) FILTER ({READ}) AS fetched, count(*) FILTER (outcome IN ('not_modified', 'unchanged')) AS unchanged,
 count(*) FILTER (outcome = 'blocked_by_robots') AS blocked, count(*) FILTER (outcome = 'failed') AS failed,
 CAST(coalesce(sum(created) FILTER ({READ}), 0) AS BIGINT) AS listings_created,
 CAST(coalesce(sum(updated) FILTER ({READ}), 0) AS BIGINT) AS listings_updated,
 CAST(coalesce(sum(same) FILTER ({READ}), 0) AS BIGINT) AS listings_unchanged,
 count(*) FILTER ({READ} AND listings = 0) AS parse_failures FROM attempts GROUP BY run_id, source_id),
 firsts AS (SELECT *, row_number() OVER (PARTITION BY run_id, source_id ORDER BY position) AS nth FROM attempts WHERE message IS NOT NULL),
 notes AS (SELECT run_id, source_id, string_agg(message, '; ' ORDER BY position) AS notes FROM firsts WHERE nth <= 3 GROUP BY ALL)"""
HEALTHY = """NOT (discovered = 0 OR (fetched <> 0 AND parse_failures >= fetched)
 OR (fetched + failed <> 0 AND failed / (fetched + failed) > 0.5))"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.crawl_report(relation(spark, sf_dir, ATTEMPTS))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.error_notes(relation(spark, sf_dir, ATTEMPTS).filter("message IS NOT NULL"))


@query("d8_crawl_report", f"{REPORTS} SELECT * FROM reports")
def crawl_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reports(spark, sf_dir)


@query("d9_error_notes", f"{REPORTS} SELECT * FROM notes")
def error_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir)


@query("d13_run_looks_healthy", f"{given(runs=CRAWL_RUNS)} SELECT source_id, run_id, {HEALTHY} AS ok FROM runs")
def run_looks_healthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = relation(spark, sf_dir, CRAWL_RUNS)
    ok = crawl.run_looks_healthy(F.col("discovered"), F.col("fetched"), F.col("failed"), F.col("parse_failures"))
    return runs.select("source_id", "run_id", ok.alias("ok"))


TIMES = """, times AS (SELECT run_id, source_id, max(attempted_at) AS ran_at,
  CAST((epoch_us(max(attempted_at)) - epoch_us(min(attempted_at))) / 1000000 AS DECIMAL(10,2)) AS duration_seconds
  FROM attempts GROUP BY run_id, source_id)"""


def _health(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = crawl.run_times(relation(spark, sf_dir, ATTEMPTS))
    return crawl.health_rows(_reports(spark, sf_dir), _notes(spark, sf_dir), times)


@query(
    "d14_health_rows",
    f"""{REPORTS}{TIMES} SELECT run_id, source_id, {stamp_sql('ran_at')}, CAST(duration_seconds AS DOUBLE) AS duration_seconds,
    discovered, fetched, unchanged, failed, parse_failures, listings_created,
    listings_updated, listings_created + listings_updated + listings_unchanged AS listings_seen, {HEALTHY} AS ok, notes
    FROM reports LEFT JOIN notes USING (run_id, source_id) JOIN times USING (run_id, source_id)""",
)
def health_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.col("duration_seconds").cast("double")
    return _health(spark, sf_dir).withColumns({"ran_at": stamp("ran_at"), "duration_seconds": seconds})


def _checked(history: str) -> str:
    """Verdicts over a history with ``source_id, ran_at, listings_seen, healthy``; regions stand for sources never run."""
    return f"""told AS (SELECT source_id, max(ran_at) AS last_run, max(ran_at) FILTER (listings_seen > 0) AS productive,
      arg_max(healthy, ran_at) AS last_ok FROM {history} GROUP BY 1),
    wanted AS (SELECT DISTINCT event_type AS source_id FROM events UNION ALL SELECT lower(r_name) FROM region),
    j AS (SELECT w.source_id, last_run, last_ok, productive,
      (epoch_us(TIMESTAMP '{CRAWL_CLOCK}') - epoch_us(productive)) / 3600000000 AS hours FROM wanted w LEFT JOIN told USING (source_id)),
    v AS (SELECT *, CASE WHEN last_run IS NULL THEN 'never run' WHEN NOT last_ok THEN 'last run failed its own checks'
      WHEN productive IS NULL THEN 'has never produced a listing'
      WHEN hours > 20 THEN 'produced no listings for ' || CAST(CAST(round_even(hours, 0) AS BIGINT) AS VARCHAR) || 'h'
      ELSE 'healthy' END AS reason FROM j)
    SELECT source_id, reason IN ('never run', 'healthy') AS ok, reason, {stamp_sql('last_run')}, round(hours, 4) AS hours_since_new FROM v"""


def _verdicts(spark: SparkSession, sf_dir: str, history: DataFrame) -> DataFrame:
    idle = table(spark, sf_dir, "region").select(F.lower("r_name").alias("source_id"))
    wanted = table(spark, sf_dir, "events").select(F.col("event_type").alias("source_id")).distinct().unionByName(idle)
    verdicts = crawl.check_health(history, wanted, clock(CRAWL_CLOCK), stale_hours=20)
    return verdicts.withColumns({"last_run": stamp("last_run"), "hours_since_new": F.round("hours_since_new", 4)})


@query(
    "d12_check_health",
    f"{given(runs=CRAWL_RUNS)}, history AS (SELECT *, {HEALTHY} AS healthy FROM runs), {_checked('history')}",
)
def check_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = relation(spark, sf_dir, CRAWL_RUNS)
    ok = crawl.run_looks_healthy(F.col("discovered"), F.col("fetched"), F.col("failed"), F.col("parse_failures"))
    return _verdicts(spark, sf_dir, runs.withColumn("ok", ok))


@query(
    "d12_check_reported_health",
    f"""{REPORTS}{TIMES}, history AS (SELECT source_id, ran_at, {HEALTHY} AS healthy,
      listings_created + listings_updated + listings_unchanged AS listings_seen FROM reports JOIN times USING (run_id, source_id)),
    {_checked('history')}""",
)
def check_reported_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts to reports, reports to health rows, health rows to verdicts."""
    return _verdicts(spark, sf_dir, _health(spark, sf_dir))
