"""Queries over the test tables that exercise the operators, each beside its SQL where SQL can say it.

Every query runs over its whole tables. Timestamps load as they are; all columns that are computed have a name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import alignment as A
from ..operators import blocks as B
from ..operators import chunking as C
from ..operators import phones as P
from ..operators import rollups as R
from ..operators import windows as W
from ..operators.normalize import normalized
from ..sources.events import events_since
from ..sources.html import chapter_links, page_parts
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: White space as a class for DuckDB's regular expressions, whose \s is ASCII only.
_S = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_S}+|{_S}+$', '', 'g')"


_WORDS_SQL = """
w AS (SELECT list(CASE WHEN n < 100 THEN u ELSE o[n // 100 + 1] || ' hundred' || CASE WHEN n % 100 > 0 THEN ' ' || u ELSE '' END END ORDER BY n) AS a FROM (
  SELECT n, o, CASE WHEN n % 100 < 20 THEN o[n % 100 + 1] WHEN n % 10 = 0 THEN t[n % 100 // 10 + 1] ELSE t[n % 100 // 10 + 1] || '-' || o[n % 10 + 1] END AS u FROM range(1000) r(n),
  (SELECT string_split('zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen', ' ') AS o, string_split('zero ten twenty thirty forty fifty sixty seventy eighty ninety', ' ') AS t)))"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {_WORDS_SQL} SELECT o_orderkey, concat_ws(' ', CASE WHEN n // 1000000 > 0 THEN a[n // 1000000 + 1] || ' million' END, CASE WHEN n // 1000 % 1000 > 0 THEN a[n // 1000 % 1000 + 1] || ' thousand' END,
CASE WHEN n % 1000 > 0 THEN a[n % 1000 + 1] END) AS price_words FROM (SELECT o_orderkey, CAST(floor(o_totalprice * 37) AS BIGINT) AS n FROM orders), w""")
def number_words_orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", N.number_words(F.floor(F.col("o_totalprice") * 37)).alias("price_words"))


@query(f"""WITH {_WORDS_SQL} SELECT DISTINCT y AS order_year, CASE WHEN y BETWEEN 2000 AND 2009 THEN 'two thousand' || CASE WHEN y % 100 > 0 THEN ' ' || a[y % 100 + 1] ELSE '' END WHEN y % 100 = 0 THEN a[y // 100 + 1] || ' hundred'
WHEN y % 100 < 10 THEN a[y // 100 + 1] || ' oh ' || a[y % 100 + 1] ELSE a[y // 100 + 1] || ' ' || a[y % 100 + 1] END AS spoken FROM (SELECT CAST(year(o_orderdate) AS INTEGER) - o_orderkey % 600 AS y FROM orders), w""")
def year_spoken_orders(spark: SparkSession, d: str) -> DataFrame:
    years = table(spark, d, "orders").select((F.year("o_orderdate") - F.col("o_orderkey") % 600).alias("order_year")).distinct()
    return years.select("order_year", N.year_words(F.col("order_year")).alias("spoken"))


@query("""SELECT c_custkey, c_custkey || CASE WHEN c_custkey % 100 BETWEEN 10 AND 20 THEN 'th' WHEN c_custkey % 10 = 1 THEN 'st' WHEN c_custkey % 10 = 2 THEN 'nd' WHEN c_custkey % 10 = 3 THEN 'rd' ELSE 'th' END AS nth FROM customer""")
def ordinal_suffix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", N.ordinal_suffix(F.col("c_custkey")).alias("nth"))


@query(f"""WITH {_WORDS_SQL}, c AS (SELECT c_custkey, coalesce(nullif(concat_ws(' ', CASE WHEN c_custkey // 1000 > 0 THEN a[c_custkey // 1000 + 1] || ' thousand' END, CASE WHEN c_custkey % 1000 > 0 THEN a[c_custkey % 1000 + 1] END), ''), 'zero') AS x FROM customer, w),
l AS (SELECT c_custkey, x, regexp_extract(x, '[a-z]+$') AS last FROM c) SELECT c_custkey, substr(x, 1, length(x) - length(last)) || CASE last WHEN 'one' THEN 'first' WHEN 'two' THEN 'second' WHEN 'three' THEN 'third' WHEN 'five' THEN 'fifth' WHEN 'eight' THEN 'eighth' WHEN 'nine' THEN 'ninth' WHEN 'twelve' THEN 'twelfth' ELSE CASE WHEN last LIKE '%y' THEN left(last, -1) || 'ieth' ELSE last || 'th' END END AS nth FROM l""")
def ordinal_words_customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", N.ordinal_words(F.col("c_custkey")).alias("nth"))


@query("""SELECT DISTINCT chapter_id, regexp_replace(regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '/book-' || lpad(CAST(book AS VARCHAR), 3, '0') || '/chapter-' || lpad(CAST(chapter AS VARCHAR), 5, '0') || '.mp3' AS object_key FROM chapters""")
def slug_object_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chapters").select("chapter_id", T.object_key(F.col("source"), F.col("book"), F.col("chapter")).alias("object_key")).distinct()


@query(f"""SELECT doc_id, {_strip_sql("regexp_replace(regexp_replace(s, '[' || chr(9) || ' ]+', ' ', 'g'), chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS clean FROM (
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(n, '{_S}*(?:\\\\\\*){{3,}}{_S}*', chr(10)||chr(10), 'g'), '{_S}*\\*{{3,}}{_S}*', chr(10)||chr(10), 'g'), '{_S}*-{{3,}}{_S}*', chr(10)||chr(10), 'g'),
'{_S}*_{{3,}}{_S}*', chr(10)||chr(10), 'g'), '{_S}*(?:\\*{_S}+){{2,}}\\*{_S}*', chr(10)||chr(10), 'g'), '(?i)<hr{_S}*/?>', chr(10)||chr(10), 'g') AS s FROM (
SELECT doc_id, regexp_replace(regexp_replace(text, '^(?:{_S}*\\[[^\\]]*\\]{_S}*|{_S}*\\d+\\.?[ \\t]*(?:\\n|$))+', ''), '^\\n+', '') AS n FROM documents))""")
def clean_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").select("doc_id", T.whitespace(T.scene_breaks(T.strip_leading_notes(F.col("text")))).alias("clean"))


@query(f"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS n, p AS paragraph FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (
SELECT doc_id, list_transform(string_split_regex(text, '\\n{_S}*\\n'), lambda x: {_strip_sql("x")}) AS ps FROM documents)) WHERE p <> ''""")
def paragraph_chunks(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("i", "paragraph"))
    return parts.select("doc_id", (F.col("i") + 1).alias("n"), "paragraph")


@query(f"""SELECT doc_id, CAST(count(*) AS BIGINT) AS sentences, CAST(max(length(s)) AS INTEGER) AS longest FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?]){_S}+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM documents) GROUP BY doc_id""")
def sentence_lengths(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.explode(T.marked_sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.char_length("s")).alias("longest"))


@query()
def normalize_steps(spark: SparkSession, d: str) -> DataFrame:
    cases = table(spark, d, "normalize_cases").select("case_id", "python", "input").distinct()
    return cases.select("case_id", normalized(F.col("input"), F.col("python")).alias("spoken"))


@query()
def normalize_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text").select("doc_id", normalized(B.blocks_to_prose(F.col("text"))).alias("spoken"))


@query()
def comparable_words(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").select("finding_id", "expected", "heard").distinct()
    return f.select("finding_id", A.compared(F.col("expected"), F.col("heard")).alias("c")).select("finding_id", "c.similarity", "c.passed", F.array_join("c.missing", " ").alias("missing"), F.array_join("c.extra", " ").alias("extra"))


@query()
def greedy_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_texts(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", C.LONG)


@query()
def finding_defects(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").select("finding_id", "context", "heard").distinct()
    return A.reading_defects(f, ["finding_id"], "context", "heard").withColumn("causes", F.array_join("causes", ","))


@query()
def finding_recall(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").select("finding_id", "context", "heard").distinct()
    return f.select("finding_id", A.word_recall(F.col("context"), F.col("heard")).alias("r")).select("finding_id", "r.*")


@query()
def phone_runs(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").select("finding_id", F.coalesce("expected", F.lit("")).alias("expected"), F.coalesce("heard", F.lit("")).alias("heard")).distinct()
    runs = F.explode(P.injected_runs(F.col("expected"), F.col("heard")))
    return f.select("finding_id", runs.alias("r")).select("finding_id", "r.*")


@query()
def phone_tails(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").select("finding_id", "context", "expected", "heard").distinct()
    return f.select("finding_id", P.tail_artifacts(F.col("context"), F.col("expected"), F.col("heard")).alias("t")).select("finding_id", "t.*").where("length is not null")


@query()
def phone_window(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").where("heard like '/%/'").select("finding_id", "expected", "heard").distinct()
    return f.select("finding_id", P.window_distance(F.col("expected"), F.col("heard")).alias("distance"))


@query()
def part_spec_blocks(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.concat(F.lit("Everyone read it twice.\n\nSize xx Brand xx\n"), F.col("p_name"), F.lit(" xx.x Price xxx\n\n"), F.col("p_type"), F.lit("\n***\nThen they left.")).alias("text"))
    return B.spec_blocks(p, "p_partkey", "text").withColumn("lines", F.array_join("lines", "\n"))


@query()
def html_links(spark: SparkSession, d: str) -> DataFrame:
    return chapter_links(_pages(spark, d), "fiction_id", "html")


@query()
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("fiction_id", page_parts(F.col("html"))["text"].alias("text"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A table of contents for each serial, as a page."""
    c = table(spark, d, "chapters").select("fiction_id", "chapter_id", "chapter", T.xml_escape(F.coalesce("title", F.lit(""))).alias("title")).distinct()
    item = F.concat(F.lit('<p><a href="/chapter/'), F.col("chapter"), F.lit('">'), F.col("title"), F.lit("</a></p>"))
    body = c.groupBy("fiction_id").agg(F.array_sort(F.collect_list(F.struct("chapter_id", item.alias("x")))).alias("xs"))
    return body.select("fiction_id", F.concat(F.lit('<style>.q{display:none}</style><div class="chapter-content"><p class="q">hidden</p>'), F.array_join(F.transform("xs", lambda x: x["x"]), ""), F.lit("</div>")).alias("html"))


@query("SELECT event_id, event_type, value FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 100")
def event_cursor(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumnRenamed("event_type", "type")
    return events_since(e, 500, 100, order="event_id").select("event_id", F.col("type").alias("event_type"), "value")


@query("SELECT seq, fiction_id, book, chapter, chunk FROM jobs QUALIFY row_number() OVER (PARTITION BY fiction_id, book, chapter, chunk ORDER BY seq) = 1")
def keep_first_dedup(spark: SparkSession, d: str) -> DataFrame:
    return W.keep_first(table(spark, d, "jobs").select("seq", "fiction_id", "book", "chapter", "chunk"), ["fiction_id", "book", "chapter", "chunk"], ["seq"])


@query("SELECT event_id, make_timestamp((max(epoch(date_trunc('second', ts))::BIGINT - rn) OVER (PARTITION BY user_id ORDER BY event_id) + rn) * 1000000) AS later FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)")
def monotone_dates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", F.date_trunc("second", "ts").alias("ts"))
    return e.select("event_id", W.increasing_times(F.col("ts"), ["user_id"], ["event_id"]).cast("timestamp_ntz").alias("later"))


@query("SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY fiction_id ORDER BY f) AS INTEGER) AS season FROM (SELECT *, min(doc_id) OVER (PARTITION BY fiction_id, source) AS f FROM documents WHERE fiction_id IS NOT NULL AND source IS NOT NULL)")
def season_numbers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "fiction_id", "source").where("fiction_id is not null and source is not null")
    return W.first_seen_number(docs, ["fiction_id"], ["source"], "doc_id", "season").select("doc_id", "season")


@query("""SELECT chapter_id, CAST(1 + sum(o) OVER (PARTITION BY source ORDER BY chapter_id) AS BIGINT) AS segment FROM (SELECT *, CASE WHEN chapter = 1 AND lag(chapter) OVER (PARTITION BY source ORDER BY chapter_id) > 1 THEN 1 ELSE 0 END AS o
FROM (SELECT DISTINCT chapter_id, source, chapter FROM chapters))""")
def series_segments(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chapters").select("chapter_id", "source", "chapter").distinct()
    return W.segments(c, ["source"], ["chapter_id"], "chapter").select("chapter_id", "segment")


@query("""SELECT chapter_id, CAST(e - coalesce(s, 0) AS DOUBLE) AS start_s, CAST(e AS DOUBLE) AS end_s FROM (SELECT chapter_id, s, sum(coalesce(s, 0)) OVER (PARTITION BY fiction_id, book ORDER BY chapter, chapter_id) AS e FROM (
SELECT DISTINCT chapter_id, fiction_id, book, chapter, CAST(audio_duration_seconds AS DECIMAL(12, 2)) AS s FROM chapters))""")
def chapter_offsets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chapters").select("chapter_id", "fiction_id", "book", "chapter", F.col("audio_duration_seconds").cast("decimal(12,2)").alias("s")).distinct()
    start, end = W.offsets("s", ["fiction_id", "book"], ["chapter", "chapter_id"])
    return c.select("chapter_id", start.cast("double").alias("start_s"), end.cast("double").alias("end_s"))


@query("""SELECT source, n AS chunks, median, p99, greatest, greatest * 1.1 AS recalibrated FROM (SELECT source, count(*) AS n, median(d) AS median, max(CASE WHEN k = least(c - 1, c * 99 // 100) THEN d END) AS p99, max(d) AS greatest FROM (
SELECT source, audio_duration_seconds AS d, row_number() OVER (PARTITION BY source ORDER BY audio_duration_seconds) - 1 AS k, count(*) OVER (PARTITION BY source) AS c FROM (SELECT DISTINCT chapter_id, source, audio_duration_seconds FROM chapters) WHERE audio_duration_seconds IS NOT NULL) GROUP BY source)""")
def pace_percentiles(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chapters").select("chapter_id", "source", "audio_duration_seconds").distinct()
    return R.pace(c, ["source"], "audio_duration_seconds", "chapter_id", 0)


@query("""SELECT fiction_id, book, grouping(fiction_id) = 1 AS is_total, count(*) AS chunks, CAST(coalesce(sum(f), 0) AS BIGINT) AS findings, count(f) AS bad_chunks, round(100.0 * count(f) / count(*), 2) AS rate FROM (SELECT DISTINCT fiction_id, book, chapter, chunk FROM chunk_results) c
LEFT JOIN (SELECT fiction_id, book, chapter, chunk, count(*) AS f FROM (SELECT DISTINCT finding_id, fiction_id, book, chapter, chunk FROM findings) GROUP BY ALL) USING (fiction_id, book, chapter, chunk) GROUP BY GROUPING SETS ((fiction_id, book), ())""")
def issue_rate_rollup(spark: SparkSession, d: str) -> DataFrame:
    keys = ["fiction_id", "book", "chapter", "chunk"]
    f = table(spark, d, "findings").select("finding_id", *keys).distinct().withColumn("unit", F.struct("chapter", "chunk"))
    c = table(spark, d, "chunk_results").select(*keys).withColumn("unit", F.struct("chapter", "chunk"))
    return R.issue_rates(f, c, ["fiction_id", "book"], "unit")


@query("""SELECT phoneme_source, coalesce(c, '(none)') AS cause, count(*) AS n FROM (SELECT phoneme_source, unnest(CASE WHEN causes IS NULL OR len(causes) = 0 THEN [NULL] ELSE causes END) AS c FROM (SELECT DISTINCT finding_id, phoneme_source, causes FROM findings)) GROUP BY ALL""")
def cause_histogram(spark: SparkSession, d: str) -> DataFrame:
    return R.cause_histogram(table(spark, d, "findings").select("finding_id", "phoneme_source", "causes").distinct(), "phoneme_source")


@query("""SELECT finding_id, CASE WHEN n >= 10 OR s > 0.9 THEN 'confirmed' WHEN NOT ok THEN 'probable_fp' WHEN n >= 8 THEN 'confirmed' WHEN n >= 6 THEN 'likely' ELSE 'borderline' END AS tier FROM (SELECT DISTINCT finding_id, coalesce(length(heard), 0) AS n, coalesce(severity, 0) AS s,
NOT (regexp_matches(c, 'AAA|BBB') OR regexp_matches(c, '(^|[^\\p{L}\\p{M}\\p{N}_])[A-Z]{3,}([^\\p{L}\\p{M}\\p{N}_]|$)') OR regexp_matches(c, '[\\p{L}\\p{M}\\p{N}_]-[\\p{L}\\p{M}\\p{N}_]+-[\\p{L}\\p{M}\\p{N}_]')) AS ok FROM (SELECT *, coalesce(context, '') AS c FROM findings))""".replace("AAA|BBB", "|".join(x * 3 for x in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")))
def tier_classification(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").select("finding_id", F.coalesce(F.char_length("heard"), F.lit(0)).alias("n"), F.coalesce("severity", F.lit(0)).alias("s"), R.reliable_text(F.coalesce("context", F.lit(""))).alias("ok")).distinct()
    return f.select("finding_id", R.confidence_tier(F.col("n"), F.col("s") > 0.9, F.col("ok")).alias("tier"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 45 THEN false WHEN l_tax <> l_discount THEN l_tax < l_discount ELSE l_extendedprice / 100000.0 - l_quantity / 50.0 > 0.06 END AS kept, l_partkey FROM lineitem""")
def keep_take_select(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    kept = R.keep_take((F.col("l_quantity") > 45).cast("int"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice") / 100000.0, F.col("l_quantity") / 50.0)
    return li.select("l_orderkey", "l_linenumber", kept.alias("kept"), "l_partkey")


@query("""SELECT fiction_id, book, chapter, chunk, seq FROM (SELECT *, row_number() OVER (PARTITION BY fiction_id, book, chapter, chunk ORDER BY CASE WHEN lower(status) = 'completed' THEN seq END ASC NULLS LAST, coalesce(CAST(priority AS DOUBLE), 0), length(text) NULLS FIRST, seq) AS n FROM jobs) WHERE n = 1""")
def best_take_jobs(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "jobs").select("fiction_id", "book", "chapter", "chunk", "seq", (F.lower("status") == "completed").alias("clean"), F.col("seq").alias("attempt"), F.col("priority").cast("double").alias("shortfall"), F.char_length("text").alias("severity"))
    return R.best_take(j, ["fiction_id", "book", "chapter", "chunk"]).select("fiction_id", "book", "chapter", "chunk", "seq")


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS weighted FROM lineitem GROUP BY l_returnflag")
def weighted_similarity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(R.weighted_mean("l_discount", "l_quantity"), 6).alias("weighted"))


@query("""SELECT o_orderpriority, n, control_hits, fix_hits, cleared, CASE WHEN control_hits > 0 THEN 100.0 * (control_hits - fix_hits) / control_hits END AS reduction FROM (SELECT o_orderpriority, count(*) AS n, CAST(sum(c) AS BIGINT) AS control_hits, CAST(sum(f) AS BIGINT) AS fix_hits, count(*) FILTER (c > 0 AND f = 0) AS cleared FROM (
SELECT o_orderpriority, CAST(o_orderkey % 3 AS BIGINT) AS c, CAST(o_custkey % 2 AS BIGINT) AS f FROM orders) GROUP BY 1)""")
def paired_experiment(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderpriority", (F.col("o_orderkey") % 3).alias("c"), (F.col("o_custkey") % 2).alias("f"))
    return R.paired(o, ["o_orderpriority"], "c", "f")


@query("SELECT text_hash, n, first_item, last_item FROM (SELECT sha256(text) AS text_hash, count(DISTINCT doc_id) AS n, min(doc_id) AS first_item, max(doc_id) AS last_item FROM documents WHERE text IS NOT NULL GROUP BY 1) WHERE n > 1")
def key_collisions(spark: SparkSession, d: str) -> DataFrame:
    return R.collisions(table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("text_hash"), "doc_id"), "text_hash", "doc_id")


@query("""SELECT o.o_orderkey, max_by(s.s_suppkey, s.s_suppkey * 1000) AS s_suppkey FROM orders o LEFT JOIN (SELECT s_nationkey, s_suppkey FROM supplier) s ON s.s_nationkey = o.o_custkey % 25 AND s.s_suppkey * 100 < o.o_orderkey GROUP BY o.o_orderkey""")
def owner_as_of(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 25).cast("int").alias("nation"))
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") * 100).alias("start"), "s_suppkey")
    return R.owner_as_of(o, s, ["nation"], "o_orderkey", "start", "s_suppkey").select("o_orderkey", "s_suppkey")


@query("""SELECT fiction_id, book, coalesce(c, n) AS n, CASE WHEN c IS NOT NULL AND n IS NOT NULL THEN 'both' WHEN c IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM (SELECT fiction_id, book, CAST(max(chapter_count) AS BIGINT) AS c FROM books GROUP BY ALL HAVING max(chapter_count) IS NOT NULL)
FULL OUTER JOIN (SELECT fiction_id, book, count(*) AS n FROM documents GROUP BY ALL) USING (fiction_id, book)""")
def source_local_full_outer(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "books").groupBy("fiction_id", "book").agg(F.max("chapter_count").cast("long").alias("n")).where("n is not null")
    return R.merged_outer(b, table(spark, d, "documents").groupBy("fiction_id", "book").agg(F.count("*").alias("n")), ["fiction_id", "book"])


@query("""WITH f AS (SELECT DISTINCT finding_id, fiction_id, book, chapter, chunk, kind, expected, phoneme_source, severity, audio_start, audio_end FROM findings WHERE fiction_id IS NOT NULL AND finding_id IS NOT NULL AND expected IS NOT NULL AND kind IS NOT NULL),
w AS (SELECT f.*, CASE WHEN len(list_filter(a, lambda x: NOT list_contains(string_split('a an the of to in on at and or but is it as be by for with that this his her he she they i you we', ' '), x))) > 0 THEN list_filter(a, lambda x: NOT list_contains(string_split('a an the of to in on at and or but is it as be by for with that this his her he she they i you we', ' '), x)) ELSE a END AS ws
FROM (SELECT *, regexp_extract_all(lower(expected), '[a-z0-9]+(?:''[a-z]+)?') AS a FROM f) f)
SELECT DISTINCT s.finding_id FROM w s JOIN w b ON s.fiction_id = b.fiction_id AND s.book = b.book AND s.chapter = b.chapter WHERE s.phoneme_source IS NOT NULL AND b.phoneme_source IS NULL AND
CASE WHEN s.kind <> 'low_confidence' THEN list_has_any(s.ws, b.ws) ELSE s.audio_start - 0.5 <= coalesce(b.audio_end, b.audio_start) AND b.audio_start - 0.5 <= coalesce(s.audio_end, s.audio_start) END""")
def confirm_overlap(spark: SparkSession, d: str) -> DataFrame:
    keys = ["fiction_id", "book", "chapter"]
    f = table(spark, d, "findings").select("finding_id", *keys, "kind", "expected", "phoneme_source", "audio_start", "audio_end").distinct().where("finding_id is not null and expected is not null and kind is not null")
    return A.confirmed(f.where("phoneme_source is null"), f.where("phoneme_source is not null"), keys).select("finding_id").distinct()


@query("""WITH f AS (SELECT DISTINCT finding_id, fiction_id, book, chapter, chunk, expected, phoneme_distance, phoneme_source FROM findings WHERE finding_id IS NOT NULL), w AS (SELECT DISTINCT finding_id, fiction_id, book, chapter, unnest(regexp_extract_all(lower(expected), '[a-z0-9]+(?:''[a-z]+)?')) AS word FROM f)
SELECT DISTINCT f.finding_id, m.fault_word, m.fault_distance FROM f LEFT JOIN (SELECT w.finding_id, max_by(w.word, (x.phoneme_distance, w.word)) AS fault_word, max(x.phoneme_distance) AS fault_distance FROM w JOIN (SELECT fiction_id, book, chapter, lower(expected) AS word, phoneme_distance FROM f WHERE phoneme_distance IS NOT NULL) x
USING (fiction_id, book, chapter, word) GROUP BY w.finding_id) m USING (finding_id)""")
def worst_match(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").select("finding_id", "fiction_id", "book", "chapter", "chunk", "expected", "phoneme_distance", "phoneme_source").distinct().where("finding_id is not null")
    faults = f.where("phoneme_distance is not null").select("fiction_id", "book", "chapter", F.col("expected").alias("word"), F.col("phoneme_distance").alias("distance"))
    return R.worst_match(f.drop("phoneme_distance"), faults, ["fiction_id", "book", "chapter"]).select("finding_id", "fault_word", "fault_distance").distinct()


@query("""SELECT doc_id, b || '-' || CAST(floor((row_number() OVER (PARTITION BY b ORDER BY n DESC, doc_id) - 1) / greatest(1, floor(100000.0 / b))) AS BIGINT) AS batch FROM (SELECT doc_id, n, CAST(pow(2, ceil(log2(greatest(n, 1)))) AS BIGINT) AS b FROM (SELECT doc_id, length(coalesce(text, '')) AS n FROM documents))""")
def length_batches(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.char_length(F.coalesce("text", F.lit(""))).alias("n"))
    return R.length_batches(docs, "doc_id", "n", 100_000).select("doc_id", "batch")


@query("""SELECT doc_id, CASE WHEN n >= 40 AND s < n / 14.0 THEN round(1 - s / (n / 14.0), 9) END AS shortfall FROM (SELECT d.doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS n, c.s FROM documents d JOIN (SELECT fiction_id, book, chapter, max(audio_duration_seconds) / 30 AS s FROM chapters GROUP BY ALL) c USING (fiction_id, book, chapter))""")
def early_stop_flags(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chapters").groupBy("fiction_id", "book", "chapter").agg((F.max("audio_duration_seconds") / 30).alias("s"))
    docs = table(spark, d, "documents").select("doc_id", "text", "fiction_id", "book", "chapter").join(c, ["fiction_id", "book", "chapter"])
    return docs.select("doc_id", F.round(P.early_stop_shortfall(F.col("text"), F.col("s"), F.lit(14.0)), 9).alias("shortfall"))


@query("""SELECT event_id, round((sum(low) OVER w + 5 - count(*) OVER w) / 5, 9) AS smoothed FROM (SELECT event_id, user_id, least(1.0, min(value / 100) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS low FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def limiter_gain(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", (F.col("value") / 100).alias("gain"))
    return W.limiter_gain(e, ["user_id"], "event_id", "gain", 2).select("event_id", F.round("smoothed", 9).alias("smoothed"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events")
def numbered_events(spark: SparkSession, d: str) -> DataFrame:
    return W.numbered(table(spark, d, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "n")
