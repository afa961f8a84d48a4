"""All queries outside the corpus operators, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import binary, query_words
from ..functions.text import host, port, setting, settings
from ..operators import archive, directory, log, search, suggest
from ..session import scratch_dir, staged, table
from ..sources import layout, page_archive
from ..streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str | None]] = {}


def _register(sql: str | None = None):
    def add(f: Query) -> Query:
        _FOUND[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return {n: f for n, (f, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql for n, (_, sql) in _FOUND.items() if sql}


# --- entries over pages and documents ---------------------------------------------------------------------------------

_PAGES = r"""
p AS (
  SELECT 'pages' AS archive, regexp_extract(url, '^[a-z]+://[^/]+/([a-z][a-z])([/?#].*)?$', 1) AS namespace, url AS path,
    regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
    CASE WHEN contains(url, '#') THEN 'redirect' ELSE 'content' END AS kind, CAST(strlen(html) AS BIGINT) AS size, page_id, html
  FROM pages
), e AS (SELECT *, namespace || '/' || path AS full_path FROM p)
"""
_RANKED = _PAGES + """, r AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY full_path, page_id) - 1 AS entry_id FROM e)
"""
_BLOBS = _RANKED + """, b AS (
  SELECT *, entry_id // 16 AS cluster_id, entry_id % 16 AS blob_id,
    CAST(coalesce(sum(size) OVER (PARTITION BY archive, entry_id // 16 ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS blob_start
  FROM r
)
"""
_HOST = "lower(regexp_extract(path, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1))"


def _entries(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return directory.entries_from_pages(table(spark, sf_dir, "pages"), **options)


def _ranked(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return directory.path_ranked(_entries(spark, sf_dir, **options))


def _points(*terms: str) -> str:
    return "CAST(" + " + ".join(f"(CASE WHEN contains(lower(title), '{t}') THEN 2 ELSE 0 END) + (CASE WHEN contains(lower(path), '{t}') THEN 1 ELSE 0 END)" for t in terms) + " AS BIGINT)"


def _found(*terms: str, any_: bool = False) -> str:
    return "(" + (" OR " if any_ else " AND ").join(f"(contains(lower(title), '{t}') OR contains(lower(path), '{t}'))" for t in terms) + ")"


@_register(f"WITH {_PAGES} SELECT full_path, title, {_points('and', 'the')} AS score FROM e WHERE namespace = 'en' AND ({_HOST} = 'example.net' OR ends_with({_HOST}, '.example.net')) AND {_found('the')} ORDER BY score DESC, full_path LIMIT 20")
def search_flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_entries(spark, sf_dir), "namespace:en site:example.net +the and")
    return found.select("full_path", "title", "score")


@_register(f"WITH {_PAGES} SELECT full_path, {_HOST} AS host FROM e WHERE {_HOST} IN ('example.com', 'example.org') OR ends_with({_HOST}, '.example.com') OR ends_with({_HOST}, '.example.org')")
def search_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.search(_entries(spark, sf_dir), "site:example.com site:example.org", limit=None)
    return found.select("full_path", host(F.col("path")).alias("host"))


@_register(f"WITH {_PAGES} SELECT full_path, namespace FROM e WHERE namespace IN ('de', 'fr')")
def search_namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_entries(spark, sf_dir), "namespace:de namespace:fr", limit=None).select("full_path", "namespace")


@_register(f"WITH {_PAGES} SELECT full_path, {_points('the', 'blog')} AS score FROM e WHERE {_found('the', 'blog', any_=True)}")
def search_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_entries(spark, sf_dir), "The blog", limit=None).select("full_path", "score")


@_register(f"WITH {_PAGES} SELECT full_path, {_points('example', 'the', 'an')} AS score FROM e WHERE {_found('the', 'an')}")
def search_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_entries(spark, sf_dir), "example +the +an", limit=None).select("full_path", "score")


@_register(f"""WITH {_PAGES}, v AS (SELECT archive, full_path, CAST(1 + page_id % 5 AS BIGINT) AS votes FROM e WHERE page_id % 10 = 3)
SELECT e.full_path, {_points('the')} AS score, votes FROM e LEFT JOIN v USING (archive, full_path) WHERE {_found('the')}
ORDER BY votes DESC NULLS LAST, score DESC, full_path LIMIT 20""")
def search_bookmarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    marks = e.where("page_id % 10 = 3").select("archive", "full_path", (1 + F.col("page_id") % 5).cast("long").alias("votes"))
    return search.boosted(search.search(e, "the", limit=None), marks).select("full_path", "score", "votes")


@_register(f"WITH {_PAGES} SELECT full_path, title FROM e WHERE full_path IN (SELECT full_path FROM e WHERE page_id % 10 = 3)")
def bookmarked_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    marks = e.where("page_id % 10 = 3")
    return directory.restricted(e, marks.unionByName(marks), ["archive", "full_path"]).select("full_path", "title")


_DOCS = "SELECT 'documents' AS archive, lang AS namespace, 'doc/' || doc_id AS path, text AS title, lang || '/doc/' || doc_id AS full_path FROM documents"


@_register(f"WITH {_PAGES}, a AS (SELECT archive, namespace, path, title, full_path FROM e UNION ALL {_DOCS}) SELECT archive, full_path, {_points('the')} AS score FROM a WHERE {_found('the')} ORDER BY score DESC, full_path, archive LIMIT 50")
def search_multi_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _entries(spark, sf_dir).unionByName(directory.entries_from_documents(table(spark, sf_dir, "documents")))
    return search.search(both, "the", limit=50).select("archive", "full_path", "score")


_TOKENS = r"list_filter(regexp_split_to_array(lower(title), '[^\p{L}\p{N}]+'), lambda w: w <> '')"


@_register(f"WITH {_PAGES}, t AS (SELECT full_path, title, CAST(len(list_intersect(list_distinct({_TOKENS}), ['the', 'und', 'zzz'])) AS BIGINT) AS shared FROM e) SELECT * FROM t WHERE shared > 0 ORDER BY shared DESC, full_path LIMIT 10")
def suggest_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.suggest(_entries(spark, sf_dir), "the und zzz")


@_register(f"WITH {_PAGES}, t AS (SELECT full_path, unnest({_TOKENS}) AS token FROM e) SELECT token, count(DISTINCT full_path) AS entries, count(*) AS uses FROM t GROUP BY token")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest.token_counts(_entries(spark, sf_dir))


@_register("SELECT 'sites' AS kind, 'example.org' AS value UNION ALL SELECT 'required', 'must' UNION ALL SELECT 'terms', 'may' UNION ALL SELECT 'terms', 'other:thing'")
def query_words_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    query_words.register(spark)
    return spark.sql("SELECT kind, value FROM query_words('site:Example.org may +Must other:thing may')")


@_register(f"WITH {_RANKED} SELECT entry_id, full_path, title FROM r WHERE entry_id >= 1 AND kind <> 'redirect'")
def entry_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.listing(_ranked(spark, sf_dir)).select("entry_id", "full_path", "title")


@_register(f"WITH {_PAGES} SELECT archive, full_path, title FROM e WHERE full_path = 'en/https://therin.example.net/en/770#top'")
def path_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.lookup(_entries(spark, sf_dir), "en/https://therin.example.net/en/770#top").select("archive", "full_path", "title")


@_register(f"WITH {_PAGES} SELECT full_path, size FROM e WHERE starts_with(full_path, 'en/https://')")
def path_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.prefixed(_entries(spark, sf_dir), "en/https://").select("full_path", "size")


@_register(f"WITH {_RANKED} SELECT archive, entry_id, full_path FROM r")
def path_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("archive", "entry_id", "full_path")


_TITLED = _RANKED + ", t AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY title, full_path, page_id) - 1 AS title_rank FROM r)"


@_register(f"WITH {_TITLED} SELECT title_rank, title, full_path FROM t")
def title_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.title_ranked(_entries(spark, sf_dir)).select("title_rank", "title", "full_path")


@_register(f"WITH {_TITLED} SELECT title_rank, entry_id, title FROM t")
def title_to_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entries(spark, sf_dir)
    titles = directory.title_ranked(e).select("archive", "page_id", "title_rank", "title")
    paths = directory.path_ranked(e).select("archive", "page_id", "entry_id")
    return titles.join(paths, ["archive", "page_id"]).select("title_rank", "entry_id", "title")


@_register(f"WITH {_RANKED} SELECT archive, entry_id AS main_page, full_path, title FROM r WHERE entry_id = (SELECT min(entry_id) FROM r WHERE kind = 'content')")
def main_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.main_pages(_ranked(spark, sf_dir))


@_register(f"WITH {_PAGES} SELECT CASE WHEN kind = 'content' THEN CASE WHEN contains(path, '.html') THEN 'text/html' ELSE 'application/octet-stream' END END AS mime_type, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM e GROUP BY 1")
def mime_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.range(2).select(F.lit("pages").alias("archive"), F.col("id").alias("mime_idx"), F.when(F.col("id") == 0, "text/html").otherwise("application/octet-stream").alias("mime_type"))
    e = _entries(spark, sf_dir).withColumn("mime_idx", F.when(F.contains("path", F.lit(".html")), 0).otherwise(1).cast("long"))
    return directory.mime_types(e, types).groupBy("mime_type").agg(F.count("*").alias("entries"), F.sum("size").alias("bytes"))


@_register(f"WITH {_PAGES} SELECT namespace, kind, count(*) AS entries, CAST(sum(size) AS BIGINT) AS bytes FROM e GROUP BY ROLLUP (namespace, kind)")
def namespace_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.profile(_entries(spark, sf_dir))


@_register(f"WITH {_BLOBS} SELECT archive, cluster_id, count(*) AS blobs, CAST(sum(size) AS BIGINT) AS bytes FROM b GROUP BY archive, cluster_id")
def cluster_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.cluster_sizes(directory.with_blobs(_ranked(spark, sf_dir)))


@_register(f"""WITH {_BLOBS}, c AS (SELECT archive, cluster_id, CAST(sum(size) AS BIGINT) AS bytes FROM b GROUP BY archive, cluster_id),
s AS (SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY archive ORDER BY cluster_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM c)
SELECT archive, cluster_id, start, coalesce(lead(start) OVER (PARTITION BY archive ORDER BY cluster_id), start + bytes) - 1 AS "end" FROM s""")
def cluster_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = directory.cluster_sizes(directory.with_blobs(_ranked(spark, sf_dir)))
    return directory.cluster_ranges(sizes).select("archive", "cluster_id", "start", "end")


@_register(f"WITH {_BLOBS} SELECT entry_id, cluster_id, blob_id, blob_start, blob_start + size AS blob_end FROM b")
def blob_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.with_blobs(_ranked(spark, sf_dir)).select("entry_id", "cluster_id", "blob_id", "blob_start", "blob_end")


@_register(f"WITH {_BLOBS} SELECT archive, entry_id, md5(html) AS digest, size FROM b")
def blob_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.blob_slices(directory.with_blobs(_ranked(spark, sf_dir, keep_data=True)))


_TARGETS = _RANKED + """, t AS (SELECT archive, kind, entry_id, last_value(CASE WHEN kind <> 'redirect' THEN entry_id END IGNORE NULLS) OVER
  (PARTITION BY archive ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS target_id FROM r)"""


@_register(f"WITH {_TARGETS} SELECT archive, entry_id, target_id FROM t WHERE kind = 'redirect'")
def redirect_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.redirect_targets(_ranked(spark, sf_dir))


@_register(f"WITH {_TARGETS}, x AS (SELECT archive, entry_id, target_id + (entry_id % 3) * 1000000 AS target_id FROM t WHERE kind = 'redirect') SELECT entry_id, target_id FROM x WHERE target_id IS NULL OR target_id NOT IN (SELECT entry_id FROM r)")
def redirect_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _ranked(spark, sf_dir)
    bent = directory.redirect_targets(r).withColumn("target_id", F.col("target_id") + (F.col("entry_id") % 3) * 1000000)
    return directory.redirect_orphans(r, bent).select("entry_id", "target_id")


@_register(f"WITH {_BLOBS} SELECT entry_id, 'Mime: 0x' || (CASE WHEN kind = 'redirect' THEN 'ffff' ELSE '0' END) || ' URL: [' || full_path || '], Title: [' || title || '], Cluster: 0x' || lower(to_hex(cluster_id)) || ' Blob: 0x' || lower(to_hex(blob_id)) AS description FROM b")
def entry_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.described(directory.with_blobs(_ranked(spark, sf_dir))).select("entry_id", "description")


_HEX = "hex(encode(html))"


@_register(rf"""SELECT page_id, CAST('0x' || substr({_HEX}, 7, 2) || substr({_HEX}, 5, 2) || substr({_HEX}, 3, 2) || substr({_HEX}, 1, 2) AS BIGINT) AS first_number,
  lower(substr({_HEX}, 17, 8) || '-' || substr({_HEX}, 25, 4) || '-' || substr({_HEX}, 29, 4) || '-' || substr({_HEX}, 33, 4) || '-' || substr({_HEX}, 37, 12)) AS uuid,
  list_filter(string_split(url, '/'), lambda x: x <> '')[1] AS first_name, url AS trimmed FROM pages""")
def binary_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Little-endian numbers, UUIDs, NUL-separated names and NUL-trimmed text, of bytes made from pages."""
    data = F.encode("html", "UTF-8")
    names = binary.nul_list(F.encode(F.regexp_replace("url", "/+", "\u0000"), "UTF-8"))
    return table(spark, sf_dir, "pages").select(
        "page_id", binary.unsigned(data, 0, 4).alias("first_number"), binary.uuid_text(data).alias("uuid"), F.element_at(names, 1).alias("first_name"), binary.trim_nul(F.concat("url", F.lit("\u0000\u0000"))).alias("trimmed")
    )


# --- message log over events ------------------------------------------------------------------------------------------

_KEY = ["user_id"]
_LOG = r"""
k AS (SELECT user_id, event_id AS seq, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
m AS (
  SELECT user_id, seq,
    CASE event_type WHEN 'view' THEN 'Group' WHEN 'click' THEN 'GroupEnd' WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'Log' ELSE 'Progress' END AS method,
    CASE event_type WHEN 'view' THEN 'g' || (k % 7) WHEN 'click' THEN 'g' || (k % 7)
      WHEN 'error' THEN '>bad' || chr(10) || 'line ' || k || chr(10) || '-' WHEN 'signup' THEN 'log    ' || k
      ELSE CASE k % 5 WHEN 0 THEN 'Parsing ' || k || ' of 99 items' WHEN 1 THEN 'Parsing items' WHEN 2 THEN 'Export ' || k WHEN 3 THEN 'Parsing (' || k || ' of 99) rows' ELSE 'Done' END END AS value
  FROM k
)
"""


def _messages(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events (of the table, or of a stream) as the message logs of their users."""
    e, k = events if events is not None else table(spark, sf_dir, "events"), F.get_json_object("props", "$.k").cast("long")
    kind = F.col("event_type")
    text = lambda *parts: F.concat(*[p.cast("string") if not isinstance(p, str) else F.lit(p) for p in parts])
    progress = F.when(k % 5 == 0, text("Parsing ", k, " of 99 items")).when(k % 5 == 1, "Parsing items").when(k % 5 == 2, text("Export ", k)).when(k % 5 == 3, text("Parsing (", k, " of 99) rows")).otherwise("Done")
    value = F.when(kind.isin("view", "click"), text("g", k % 7)).when(kind == "error", text(">bad\nline ", k, "\n-")).when(kind == "signup", text("log\t", k)).otherwise(progress)
    method = F.when(kind == "view", "Group").when(kind == "click", "GroupEnd").when(kind == "error", "Error").when(kind == "signup", "Log").otherwise("Progress")
    return e.select("user_id", F.col("event_id").alias("seq"), method.alias("method"), log.message(value).alias("value"))


_DEPTH = f"""{_LOG}, s AS (SELECT *, sum(CASE method WHEN 'Group' THEN 1 WHEN 'GroupEnd' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS s FROM m),
a AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY user_id ORDER BY seq)) AS after FROM s),
d AS (SELECT *, CAST(after - (CASE WHEN method = 'Group' THEN 1 ELSE 0 END) AS BIGINT) AS depth FROM a)"""


@_register(f"WITH {_DEPTH} SELECT user_id, seq, depth FROM d")
def log_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.with_depth(_messages(spark, sf_dir), _KEY).select("user_id", "seq", "depth")


@_register(f"""WITH {_DEPTH}, o AS (SELECT *, s + 2 - least(0, 2 + min(s) OVER (PARTITION BY user_id ORDER BY seq)) AS deeper FROM s)
SELECT user_id, seq, CAST(deeper - (CASE WHEN method = 'Group' THEN 1 ELSE 0 END) AS BIGINT) AS depth FROM o""")
def log_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.with_depth(_messages(spark, sf_dir), _KEY, offset=2).select("user_id", "seq", "depth")


_K = "json_extract_string(props, '$.k')"


@_register(f"""SELECT event_id, {_K} AS k, 'none' AS z, CASE WHEN TRY_CAST({_K} || '00' AS BIGINT) BETWEEN 1 AND 65534 THEN TRY_CAST({_K} || '00' AS BIGINT) END AS port,
  '{{"event_type":"' || event_type || '","user_id":' || user_id || '}}' AS written FROM events""")
def event_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects read as maps, looked up with and without presence, parsed as ports, and written again."""
    e = table(spark, sf_dir, "events").withColumn("m", settings(F.col("props")))
    return e.select("event_id", setting(F.col("m"), "k", "").alias("k"), setting(F.col("m"), "z", "none").alias("z"), port(F.concat(setting(F.col("m"), "k", ""), F.lit("00"))).alias("port"), F.to_json(F.struct("event_type", "user_id")).alias("written"))


_WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
_BEFORE = "array_to_string({0}[1:list_position({0}, 'of') - 2], ' ')"
_AFTER = "array_to_string({0}[list_position({0}, 'of') + 2:], ' ')"
_SAME = f"""CASE WHEN NOT (n_method = 'Progress' AND method = 'Progress') THEN n_method = method AND n_value = value
  WHEN contains(n_value, ' of ') AND contains(value, ' of ') THEN
    CASE WHEN list_position(nw, 'of') > 1 AND list_position(nw, 'of') < len(nw) AND list_position(w, 'of') > 1 AND list_position(w, 'of') < len(w)
      AND list_position(nw, 'of') = list_position(w, 'of') AND len(nw) = len(w)
    THEN {_BEFORE.format('nw')} = {_BEFORE.format('w')} AND {_AFTER.format('nw')} = {_AFTER.format('w')} ELSE n_value = value END
  WHEN contains(n_value, ' of ') THEN coalesce(list_position(nw, 'of') > 1 AND list_position(nw, 'of') < len(nw) AND starts_with(value, {_BEFORE.format('nw')}) AND ends_with(value, {_AFTER.format('nw')}), false)
  WHEN contains(value, ' of ') THEN false
  ELSE n_value = value OR (starts_with(n_value, 'Export') AND starts_with(value, 'Export')) OR (starts_with(n_value, 'Parse') AND starts_with(value, 'Parse')) OR (starts_with(n_value, 'Update') AND starts_with(value, 'Update')) END"""
_NEXT = f"""{_LOG}, n AS (SELECT *, lead(method) OVER w AS n_method, lead(value) OVER w AS n_value FROM m WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
x AS (SELECT *, {_WORDS.format('n_value')} AS nw, {_WORDS.format('value')} AS w FROM n)"""


@_register(f"WITH {_NEXT} SELECT user_id, seq, method, value FROM x WHERE NOT coalesce(n_method = 'Progress' AND ({_SAME}), false)")
def log_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.collapsed(_messages(spark, sf_dir), _KEY)


@_register(f"WITH {_NEXT} SELECT user_id, seq, coalesce({_SAME}, false) AS same FROM x WHERE n_method IS NOT NULL")
def progress_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = log.with_next(_messages(spark, sf_dir), _KEY).where("next_method is not null")
    return n.select("user_id", "seq", log.same(F.col("next_method"), F.col("next_value"), F.col("method"), F.col("value")).alias("same"))


@_register(f"WITH {_LOG} SELECT user_id, seq, method FROM m WHERE method = 'Error'")
def log_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.reset(_messages(spark, sf_dir), errors=False).select("user_id", "seq", "method")


@_register(f"""WITH {_LOG}, f AS (SELECT user_id, min(seq) AS f FROM m WHERE method = 'Group' AND starts_with(value, 'g3') GROUP BY user_id),
t AS (SELECT user_id, max(seq) AS t FROM m WHERE method = 'GroupEnd' AND starts_with(value, 'g3') GROUP BY user_id),
c AS (SELECT f.user_id, f FROM f LEFT JOIN t USING (user_id) WHERE t IS NULL OR t < f)
SELECT m.user_id, seq, method FROM m LEFT JOIN c USING (user_id) WHERE f IS NULL OR seq <= f""")
def log_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.cleared(_messages(spark, sf_dir), _KEY, "g3\nignored").select("user_id", "seq", "method")


@_register(f"WITH {_LOG}, t AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS n FROM m) SELECT user_id, seq, method, value FROM t WHERE n <= 5")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.tail(_messages(spark, sf_dir), _KEY, 5)


@_register(f"""WITH {_LOG}, l AS (SELECT user_id, seq, string_split(value, chr(10)) AS parts FROM m), i AS (SELECT user_id, seq, parts, unnest(range(len(parts))) AS i FROM l)
SELECT user_id, seq, CAST(i AS INTEGER) AS line_no, (CASE WHEN parts[i + 1][1] IN ('>', '-') THEN '-' ELSE ' ' END) || parts[i + 1] AS line FROM i""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.lines(_messages(spark, sf_dir)).select("user_id", "seq", "line_no", "line")


@_register(f"""WITH {_DEPTH}, l AS (SELECT *, string_split(value, chr(10)) AS parts FROM d), i AS (SELECT *, unnest(range(len(parts))) AS i FROM l)
SELECT user_id, seq, CAST(i AS INTEGER) AS line_no, method = 'Error' AS to_errors, repeat('|', depth) || (CASE WHEN parts[i + 1][1] IN ('>', '-') THEN '-' ELSE ' ' END) || parts[i + 1] AS shown FROM i""")
def log_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.rendered(_messages(spark, sf_dir), _KEY)


@_register(f"WITH {_LOG} SELECT user_id, count(*) AS length, bool_or(method = 'Error') AS has_errors FROM m GROUP BY user_id")
def log_has_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.summary(_messages(spark, sf_dir), _KEY)


@_register(f"WITH {_LOG} SELECT user_id, seq, method FROM m WHERE method IN ('Log', 'Progress')")
def log_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    switches = {"Group": False, "Log": True, "Info": True, "Warn": True, "Error": False, "Progress": True}
    return log.enabled(_messages(spark, sf_dir), switches).select("user_id", "seq", "method")


# --- archives: pages written as files of up to 100 entries and read back -----------------------------------------------

_CHUNK = 100
_ARCHIVES = _RANKED + f""", h AS (SELECT entry_id AS rank, printf('pages-%06d', entry_id // {_CHUNK}) AS archive, kind, left(namespace || 'x', 1) || '/' || path AS full_path, path, title, html FROM r),
g AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'content' THEN full_path END IGNORE NULLS) OVER (PARTITION BY archive ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  first_value(CASE WHEN kind = 'content' THEN full_path END IGNORE NULLS) OVER (PARTITION BY archive ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS target FROM h),
w AS (SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY full_path) - 1 AS entry_id, kind, full_path, path, title, target, html,
  count(*) FILTER (WHERE kind = 'content') OVER (PARTITION BY archive ORDER BY full_path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS nth FROM g)
"""


def _written(spark: SparkSession, sf_dir: str) -> str:
    """Writes pages as archives into a new folder. A namespace is one letter in an archive; its first stands here.

    A redirect points to the last content entry before it in its archive, else to the first after it, else to none.
    """
    from pyspark.sql import Window

    r = _ranked(spark, sf_dir, keep_data=True).withColumn("archive", F.format_string("pages-%06d", F.floor(F.col("entry_id") / _CHUNK)))
    w, content = Window.partitionBy("archive").orderBy("entry_id"), F.when(F.col("kind") == "content", F.struct("namespace", "path"))
    before, after = F.last(content, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(content, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    r = r.withColumn("target", F.coalesce(before, after))
    letter = lambda ns: F.substring(F.concat(ns, F.lit("x")), 1, 1)
    target = F.when(F.col("kind") == "redirect", F.coalesce(F.concat(letter(F.col("target.namespace")), F.lit("/"), F.col("target.path")), F.lit("")))
    rows = r.select("archive", letter(F.col("namespace")).alias("namespace"), "path", "title", target.alias("redirect_path"), F.encode("data", "UTF-8").alias("data"))
    folder = f"{scratch_dir(spark)}/archives-{uuid.uuid4().hex[:12]}"
    archive.write_archives(rows, folder).write.format("noop").mode("overwrite").save()
    return folder


@_register(f"WITH {_ARCHIVES} SELECT archive, 5 AS major, count(*) AS entry_count, CAST(ceil(count(*) FILTER (WHERE kind = 'content') / 16.0) AS BIGINT) AS cluster_count, min(entry_id) FILTER (WHERE kind = 'content') AS main_page, CAST(NULL AS VARCHAR) AS error FROM w GROUP BY archive")
def archive_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_archive.section(spark, _written(spark, sf_dir), "header").select("archive", "major", "entry_count", "cluster_count", "main_page", "error")


@_register(f"WITH {_ARCHIVES} SELECT DISTINCT archive, CAST(0 AS BIGINT) AS mime_idx, 'text/html' AS mime_type FROM w")
def archive_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_archive.section(spark, _written(spark, sf_dir), "mime")


@_register(f"WITH {_ARCHIVES} SELECT archive, entry_id, kind, full_path, title, CASE WHEN kind = 'content' THEN 'text/html' END AS mime_type, CASE WHEN kind = 'content' THEN nth // 16 END AS cluster_id, CASE WHEN kind = 'content' THEN nth % 16 END AS blob_id FROM w")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_archive.section(spark, _written(spark, sf_dir), "entries").select("archive", "entry_id", "kind", "full_path", "title", "mime_type", "cluster_id", "blob_id")


@_register(f"WITH {_ARCHIVES} SELECT archive, full_path, md5(html) AS digest FROM w WHERE kind = 'content'")
def archive_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir)
    e = page_archive.section(spark, folder, "entries").where("kind = 'content'")
    return archive.with_data(e, page_archive.section(spark, folder, "blobs")).select("archive", "full_path", F.md5("data").alias("digest"))


@_register(f"WITH {_ARCHIVES} SELECT archive, entry_id, full_path FROM w WHERE starts_with(full_path, 'e/https://b')")
def archive_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = page_archive.section(spark, _written(spark, sf_dir), "entries")
    return e.where(F.startswith("full_path", F.lit("e/https://b"))).select("archive", "entry_id", "full_path")


@_register(f"WITH {_ARCHIVES} SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY title, entry_id) - 1 AS title_rank, entry_id, title FROM w")
def archive_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir)
    return archive.titles_in_order(page_archive.section(spark, folder, "titles"), page_archive.section(spark, folder, "entries"))


@_register(f"WITH {_ARCHIVES} SELECT archive, nth // 16 AS cluster_id, CAST(CASE WHEN (nth // 16) % 2 = 0 THEN 1 ELSE 4 END AS SMALLINT) AS compression, count(*) AS blobs FROM w WHERE kind = 'content' GROUP BY ALL")
def archive_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir)
    blobs = page_archive.section(spark, folder, "blobs").groupBy("archive", "cluster_id").agg(F.count("*").alias("blobs"))
    return page_archive.section(spark, folder, "clusters").join(blobs, ["archive", "cluster_id"]).select("archive", "cluster_id", "compression", "blobs")


@_register(f"WITH {_ARCHIVES} SELECT r.archive, r.entry_id, t.entry_id AS final_id FROM w r LEFT JOIN w t ON r.archive = t.archive AND r.target = t.full_path WHERE r.kind = 'redirect'")
def archive_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = page_archive.section(spark, _written(spark, sf_dir), "entries").select("archive", "entry_id", "kind", "full_path", "redirect_id")
    e = staged(e.repartition("archive", "entry_id"), "entries")  # read four times; not a file for each archive
    return directory.ends_by_path(directory.resolve_redirects(e), e)


@_register(f"WITH {_ARCHIVES} SELECT archive, entry_id, full_path, title FROM w WHERE kind = 'content' AND nth = 0")
def archive_main_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir)
    return archive.main_page(page_archive.section(spark, folder, "header"), page_archive.section(spark, folder, "entries"))


_SHA = "sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(archive))"


@_register(f"""WITH {_ARCHIVES}, n AS (SELECT DISTINCT archive, {_SHA} AS s FROM w)
SELECT archive, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || substr('89ab89ab89ab89ab', instr('0123456789abcdef', s[17:17]), 1) || s[18:20] || '-' || s[21:32] AS uuid FROM n""")
def archive_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_archive.section(spark, _written(spark, sf_dir), "header").select("archive", "uuid")


@_register(f"WITH {_ARCHIVES} SELECT archive, entry_id, full_path, true AS same_offset FROM w")
def archive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir)
    paths = page_archive.section(spark, folder, "paths").withColumnRenamed("offset", "listed")
    return paths.join(page_archive.section(spark, folder, "entries"), ["archive", "entry_id"]).select("archive", "entry_id", "full_path", (F.col("listed") == F.col("offset")).alias("same_offset"))


@_register(f"WITH {_ARCHIVES} SELECT archive, entry_id, kind, title FROM w WHERE full_path = 'e/https://therin.example.net/en/770#top'")
def archive_exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = page_archive.section(spark, _written(spark, sf_dir), "entries")
    return directory.lookup(e, "e/https://therin.example.net/en/770#top").select("archive", "entry_id", "kind", "title")


@_register(f"WITH {_ARCHIVES} SELECT archive, entry_id, coalesce(nullif(title, ''), path) AS display_title FROM w")
def archive_display_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.with_display_title(page_archive.section(spark, _written(spark, sf_dir), "entries")).select("archive", "entry_id", "display_title")


@_register(f"WITH {_ARCHIVES} SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY title, entry_id) - 1 AS title_rank, entry_id, archive || ' ' || entry_id AS result FROM w")
def archive_each_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.each_title(page_archive.section(spark, _written(spark, sf_dir), "titles"), lambda name, rank, entry: f"{name} {entry}")


@_register(f"WITH {_ARCHIVES} SELECT archive, entry_id, full_path FROM w WHERE kind = 'content'")
def archive_entries_with_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _written(spark, sf_dir)
    found = directory.restricted(page_archive.section(spark, folder, "entries"), page_archive.section(spark, folder, "blobs"), ["archive", "cluster_id", "blob_id"])
    return found.select("archive", "entry_id", "full_path")


@_register("""SELECT 'a-good' AS archive, CAST(1 AS BIGINT) AS entry_count, CAST(NULL AS VARCHAR) AS error UNION ALL SELECT 'b-magic', NULL, 'this is no page archive'
UNION ALL SELECT 'c-version', NULL, 'version 6 is not supported' UNION ALL SELECT 'd-cut', NULL, '80 bytes at 0 go past the end'""")
def archive_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives that can't be read give a row with the reason, and the others are read."""
    folder = f"{scratch_dir(spark)}/archives-{uuid.uuid4().hex[:12]}"
    entry = {"type": 0, "namespace": "A", "path": "p", "title": "t", "cluster_id": 0, "blob_id": 0}
    build = lambda **x: layout.build([entry], ["text/html"], [layout.pack_cluster([b"x"], 1)], **x)
    for name, data in {"a-good": build(), "b-magic": b"?" + build()[1:], "c-version": build(major=6), "d-cut": build()[:50]}.items():
        archive.put(folder, name, data)
    return page_archive.section(spark, folder, "header").select("archive", "entry_count", "error")


# --- streams ----------------------------------------------------------------------------------------------------------


@_register("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, CAST(round(sum(value) * 100) AS BIGINT) AS cents FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = streams.drain(streams.windowed_counts(streams.stream(spark, f"{sf_dir}/events.parquet")), "windows")
    return counts.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round(F.col("value_sum") * 100).cast("long").alias("cents"))


@_register("""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM o)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM s GROUP BY user_id, n""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = streams.drain(streams.sessions(streams.stream(spark, f"{sf_dir}/events.parquet")), "sessions")
    ntz = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return out.select("user_id", ntz("session_start"), ntz("session_end"), "events")


@_register("SELECT event_id, user_id, event_type FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event comes twice and is passed on once."""
    one = lambda: streams.stream(spark, f"{sf_dir}/events.parquet")
    return streams.drain(streams.deduplicated(one().union(one())), "distinct", "append").select("event_id", "user_id", "event_type")


@_register(f"WITH {_NEXT} SELECT user_id AS log, seq, method, value FROM x WHERE n_method IS NOT NULL AND NOT coalesce(n_method = 'Progress' AND ({_SAME}), false)")
def stream_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collapsed logs without their last message, which the stream still holds open."""
    m = _messages(spark, sf_dir, streams.stream(spark, f"{sf_dir}/events.parquet")).withColumnRenamed("user_id", "log")
    return streams.drain(streams.collapsed_stream(m), "collapse", "append")
