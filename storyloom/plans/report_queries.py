"""Queries of the operators on commentary, verdicts, takes and reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import blocks as B
from ..operators import commentary as C
from ..operators import phones as P
from ..operators import reports as R
from ..operators import takes as K
from ..operators import verdicts as V
from ..sources.tables import table
from .queries import _S, _strip_sql, query

_NOTES_SQL = "(?i)^(?:" + "|".join([C.SIGN_OFF, *(p.replace(" ", r"\s+") for p in C.NOTE_OPENINGS)]).replace("'", "''") + ")"


def _chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, some of which are made into notes and sign-offs by their number."""
    c = table(spark, d, "chunk_results").select("row_id", "fiction_id", "book", "chapter", "chunk", "text")
    note = F.when(F.col("row_id") % 5 == 0, F.concat(F.lit("Next chapter: "), F.col("text"))).when(F.col("row_id") % 23 == 0, F.concat(F.col("text"), F.lit(" Thanks for your suport!")))
    return c.withColumn("text", F.coalesce(note, "text"))


_CHUNKS_SQL = "SELECT row_id, fiction_id, book, chapter, chunk, CASE WHEN row_id % 5 = 0 THEN 'Next chapter: ' || text WHEN row_id % 23 = 0 THEN text || ' Thanks for your suport!' ELSE text END AS text FROM chunk_results"


@query(f"""WITH c AS (SELECT *, coalesce({_strip_sql("text")} = '' OR regexp_matches({_strip_sql("text")}, '{_NOTES_SQL}'), false) AS note, coalesce(regexp_matches(text, '(?i){C.SIGN_OFF}'), false) AS ends FROM ({_CHUNKS_SQL})),
f AS (SELECT *, min(CASE WHEN ends THEN chunk END) OVER (PARTITION BY fiction_id, book, chapter) AS first_end FROM c), l AS (SELECT *, max(CASE WHEN NOT note AND (first_end IS NULL OR chunk <= first_end) THEN chunk END) OVER (PARTITION BY fiction_id, book, chapter) AS last_story FROM f)
SELECT row_id, coalesce(chunk <= last_story, false) AS kept FROM l""")
def signoff_cascade(spark: SparkSession, d: str) -> DataFrame:
    return C.story_chunks(_chunk_texts(spark, d), ["fiction_id", "book", "chapter"], "chunk", "text").select("row_id", "kept")


@query(rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)\n{_S}*…+{_S}*\n.*$', ''), '(?s)\n{_S}*\.{_S}*\n.*$', ''), '(?is)\n{_S}*{C.SIGN_OFF}.*$', ''), '{_S}+$', '') || chr(10) AS story
FROM (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN chr(10) || ' … ' || chr(10) || 'Bye.' WHEN 1 THEN chr(10) || '.' || chr(10) || 'Notes' ELSE chr(10) || 'thanks  for your supporrt! More.' END AS t FROM documents)""")
def trailing_commentary(spark: SparkSession, d: str) -> DataFrame:
    end = F.when(F.col("doc_id") % 3 == 0, "\n … \nBye.").when(F.col("doc_id") % 3 == 1, "\n.\nNotes").otherwise("\nthanks  for your supporrt! More.")
    return table(spark, d, "documents").select("doc_id", C.without_trailing_notes(F.concat("text", end)).alias("story"))


@query(f"""SELECT DISTINCT chapter_id, nullif(regexp_extract(t, '{C.POST_TITLE}', 1), '') AS series, CAST(regexp_extract(t, '{C.POST_TITLE}', 2) AS INTEGER) + CASE WHEN regexp_extract(t, '{C.POST_TITLE}', 1) = 'DoF' THEN 7 ELSE 0 END AS book, CAST(regexp_extract(t, '{C.POST_TITLE}', 3) AS INTEGER) AS chapter,
{_strip_sql(f"regexp_extract(t, '{C.POST_TITLE}', 4)")} AS title FROM (SELECT chapter_id, {_strip_sql("CASE chapter_id % 3 WHEN 0 THEN 'DoF ' WHEN 1 THEN '' ELSE 'Notes on ' END || book || '.' || chapter || ' - ' || string_split(title, chr(10))[1] || ' [T3]'")} AS t FROM chapters) WHERE regexp_matches(t, '{C.POST_TITLE}')""")
def chapter_post_titles(spark: SparkSession, d: str) -> DataFrame:
    lead = F.when(F.col("chapter_id") % 3 == 0, "DoF ").when(F.col("chapter_id") % 3 == 1, "").otherwise("Notes on ")
    c = table(spark, d, "chapters").select("chapter_id", F.concat(lead, "book", F.lit("."), "chapter", F.lit(" - "), F.get(F.split("title", "\n"), F.lit(0)), F.lit(" [T3]")).alias("t")).distinct()
    return c.select("chapter_id", C.post_title(F.col("t"), {"DoF": 7}).alias("p")).where("p is not null").select("chapter_id", "p.*")


@query("SELECT tier, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM t), 2) AS share, tier <> 'probable_fp' AS kept FROM (SELECT CASE WHEN severity > 0.9 THEN 'confirmed' WHEN severity > 0.7 THEN 'likely' WHEN severity > 0.4 THEN 'borderline' ELSE 'probable_fp' END AS tier FROM findings) t GROUP BY tier".replace("FROM t)", "FROM findings)"))
def tier_histogram(spark: SparkSession, d: str) -> DataFrame:
    return R.tier_histogram(table(spark, d, "findings").select(_tier().alias("tier")))


def _tier() -> Column:
    s = F.col("severity")
    return F.when(s > 0.9, "confirmed").when(s > 0.7, "likely").when(s > 0.4, "borderline").otherwise("probable_fp")


@query("""SELECT DISTINCT finding_id, round(least(0.99, CASE WHEN severity > 0.9 THEN 0.90 WHEN severity > 0.7 THEN 0.70 WHEN severity > 0.4 THEN 0.45 ELSE 0.20 END::DOUBLE + CASE WHEN phoneme_source = 'whisper' THEN 0.06 ELSE 0 END::DOUBLE + 0.005::DOUBLE * least(coalesce(length(heard), 0), 12)), 3) AS score FROM findings""")
def confidence_scores(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").select("finding_id", "severity", "phoneme_source", "heard")
    return f.select("finding_id", R.confidence_score(_tier(), F.col("phoneme_source") == "whisper", F.char_length("heard")).alias("score")).distinct()


@query(f"""SELECT row_id, CASE WHEN b = 0 OR n - pos <= 12 THEN t || ' ⟨▓⟩' ELSE substr(t, 1, pos + b - 1) || ' ⟨▓⟩' || substr(t, pos + b) END AS marked FROM (SELECT *, instr(substr(t, pos + 1), ' ') AS b FROM (SELECT *, least(n, CAST(floor((row_id % 10 / 10.0) * n) AS INTEGER)) AS pos FROM (
SELECT row_id, regexp_replace(text, '{_S}+$', '') AS t, length(regexp_replace(text, '{_S}+$', '')) AS n FROM chunk_results)))""")
def position_marks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_results").select("row_id", R.marked_at(F.col("text"), F.col("row_id") % 10 / F.lit(10.0)).alias("marked"))


@query(f"""SELECT row_id, CASE WHEN p >= 0.8 AND regexp_matches(w, '^\\p{{Lu}}') THEN 'trailing proper noun' WHEN p >= 0.85 THEN 'chunk-end' WHEN p <= 0.2 THEN 'chunk-start' ELSE 'mid-chunk' END AS bucket FROM (SELECT row_id, row_id % 21 / 20.0 AS p,
regexp_replace(list_last(string_split_regex({_strip_sql("text")}, '{_S}+')), '^[.,!?"''’”]+|[.,!?"''’”]+$', '', 'g') AS w FROM chunk_results WHERE text IS NOT NULL)""")
def residual_buckets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_results").where("text is not null").select("row_id", R.residual_bucket(F.col("row_id") % 21 / F.lit(20.0), F.col("text")).alias("bucket"))


@query("SELECT DISTINCT chapter_id, CASE WHEN s > 0 AND n > 0 THEN round(s / (n / 13.0::DOUBLE), 2) END AS ratio, CASE WHEN s > 0 AND n > 0 THEN round(s / (n / 13.0::DOUBLE), 2) >= 1.45 END AS stretched FROM (SELECT chapter_id, audio_duration_seconds AS s, length(title) * 400 AS n FROM chapters)")
def duration_ratios(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chapters").select("chapter_id", R.duration_ratio(F.col("audio_duration_seconds"), F.char_length("title") * 400).alias("ratio")).distinct()
    return c.withColumn("stretched", F.col("ratio") >= R.STRETCHED)


@query("SELECT finding_id, kind, severity FROM (SELECT DISTINCT finding_id, kind, severity FROM findings) WHERE severity >= 0.5 OR kind = 'early_stop' ORDER BY severity DESC NULLS LAST, finding_id LIMIT 50")
def top_findings(spark: SparkSession, d: str) -> DataFrame:
    return R.top_findings(table(spark, d, "findings").select("finding_id", "kind", "severity").distinct(), 0.5, 50)


@query("""SELECT * FROM (SELECT finding_id, 1 AS stratum FROM f WHERE a ORDER BY severity DESC NULLS LAST, finding_id LIMIT 30) UNION ALL SELECT * FROM (SELECT finding_id, 2 FROM f WHERE NOT coalesce(a, false) AND b ORDER BY severity DESC NULLS LAST, finding_id LIMIT 60)""".replace("FROM f", "FROM (SELECT DISTINCT finding_id, severity, phoneme_source = 'xtts' AS a, regexp_matches(expected, '^\\p{Lu}') AS b FROM findings)"))
def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "findings").select("finding_id", "severity", "phoneme_source", "expected").distinct()
    return R.stratified_pick(f, F.col("phoneme_source") == "xtts", F.col("expected").rlike(r"^\p{Lu}"), [F.desc_nulls_last("severity"), "finding_id"], 90).select("finding_id", "stratum")


@query("""SELECT fiction_id, min(a) AS first_at, max(b) AS last_at, count(book) AS books, CAST(sum(n) AS BIGINT) AS chapters, string_agg(book || ':' || n, ',' ORDER BY book) AS by_book FROM (SELECT fiction_id, book, count(*) AS n, min(posted_at) AS a, max(posted_at) AS b FROM documents GROUP BY ALL) GROUP BY fiction_id""")
def series_summary(spark: SparkSession, d: str) -> DataFrame:
    s = R.series_summary(table(spark, d, "documents").select("fiction_id", "book", "posted_at"), "fiction_id", "book", "posted_at")
    pairs = F.transform(F.filter("by_book", lambda x: x["book"].isNotNull()), lambda x: F.concat_ws(":", x["book"].cast("string"), x["n"].cast("string")))
    return s.withColumn("by_book", F.when(F.size(pairs) > 0, F.array_join(pairs, ",")))


@query("""SELECT d.doc_id, d.number, s.title FROM (SELECT doc_id, fiction_id, book, row_number() OVER (PARTITION BY fiction_id, book ORDER BY doc_id) AS number FROM documents) d LEFT JOIN (SELECT fiction_id, book, title, row_number() OVER (PARTITION BY fiction_id, book ORDER BY chapter, chapter_id, title) AS number FROM (SELECT DISTINCT fiction_id, book, chapter, chapter_id, title FROM chapters))
s USING (fiction_id, book, number)""")
def positional_backfill(spark: SparkSession, d: str) -> DataFrame:
    docs = R.renumbered(table(spark, d, "documents").select("doc_id", "fiction_id", "book"), ["fiction_id", "book"], ["doc_id"])
    source = table(spark, d, "chapters").select("fiction_id", "book", "chapter", "chapter_id", "title").distinct()
    return R.by_position(docs, source, ["fiction_id", "book"], "number", ["chapter", "chapter_id", "title"]).select("doc_id", "number", "title")


@query("""SELECT fiction_id, book, chapter, bool_or(r.n IS NULL OR p.n IS NULL OR r.n IS DISTINCT FROM p.n) AND count(p.c) > 0 AS stale FROM (SELECT fiction_id, book, chapter, chunk, max(length(text)) AS n FROM chunk_results WHERE fiction_id IS NOT NULL AND book IS NOT NULL AND chapter IS NOT NULL AND chunk IS NOT NULL GROUP BY ALL HAVING max(length(text)) IS NOT NULL) r FULL OUTER JOIN
(SELECT fiction_id, book, chapter, chunk, max(length(text)) AS n, max(chunk) AS c FROM jobs WHERE fiction_id IS NOT NULL AND book IS NOT NULL AND chapter IS NOT NULL AND chunk IS NOT NULL GROUP BY ALL HAVING max(length(text)) IS NOT NULL) p USING (fiction_id, book, chapter, chunk) GROUP BY ALL""")
def staleness_manifest(spark: SparkSession, d: str) -> DataFrame:
    keys = ["fiction_id", "book", "chapter", "chunk"]
    sized = lambda name: table(spark, d, name).dropna(subset=keys).groupBy(*keys).agg(F.max(F.char_length("text")).alias("size")).where("size is not null")
    return R.stale_outputs(sized("chunk_results"), sized("jobs"), keys[:3], "chunk")


@query("SELECT DISTINCT fiction_id, book, chapter, chunk FROM chunk_results WHERE (fiction_id, book, chapter, chunk) NOT IN (SELECT (fiction_id, book, chapter, chunk) FROM jobs WHERE fiction_id IS NOT NULL AND book IS NOT NULL AND chapter IS NOT NULL AND chunk IS NOT NULL)")
def not_yet_done(spark: SparkSession, d: str) -> DataFrame:
    keys = ["fiction_id", "book", "chapter", "chunk"]
    return R.not_yet(table(spark, d, "chunk_results").select(*keys).distinct(), table(spark, d, "jobs"), keys)


@query("""SELECT p_partkey, CASE WHEN s_suppkey IS NULL THEN 'missing' WHEN p_size <> s_suppkey % 50 + 1 THEN 'size' WHEN NOT contains(tag, '-') AND md5(p_name) <> tag THEN 'content' END AS reason FROM part LEFT JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN md5(s_name) ELSE md5(s_name) || '-2' END AS tag FROM supplier) ON p_partkey = s_suppkey""")
def upload_reasons(spark: SparkSession, d: str) -> DataFrame:
    local = table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size"), F.md5("p_name").alias("md5"))
    tag = F.when(F.col("s_suppkey") % 2 == 0, F.md5("s_name")).otherwise(F.concat(F.md5("s_name"), F.lit("-2")))
    remote = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), (F.col("s_suppkey") % 50 + 1).alias("size"), tag.alias("etag"))
    return R.upload_reason(local, remote, "p_partkey")


@query("SELECT fiction_id, count(DISTINCT (coalesce(profile, '~'), chunk > 0)) = 1 AS uniform, max_by(row_id, (coalesce(length(text), -1), row_id)) AS row_id FROM chunk_results GROUP BY fiction_id")
def uniform_and_largest(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunk_results").select("fiction_id", "row_id", F.coalesce("profile", F.lit("~")).alias("profile"), (F.col("chunk") > 0).alias("some"), F.coalesce(F.char_length("text"), F.lit(-1)).alias("size"))
    return R.uniform(c, ["fiction_id"], ["profile", "some"]).join(R.largest(c, ["fiction_id"], "row_id", "size").withColumnRenamed("fiction_id", "_f"), F.col("fiction_id").eqNullSafe(F.col("_f"))).drop("_f")


@query("""SELECT fiction_id, book, string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || CAST(round((e - s) * 1000) AS BIGINT) || chr(10) || 'END=' || CAST(round(e * 1000) AS BIGINT) || chr(10) || 'title=' || chapter_id, chr(10) ORDER BY chapter_id) AS marks FROM (SELECT chapter_id, fiction_id, book, s, sum(s) OVER (PARTITION BY fiction_id, book ORDER BY chapter_id) AS e FROM (
SELECT chapter_id, any_value(fiction_id) AS fiction_id, any_value(book) AS book, CAST(max(coalesce(audio_duration_seconds, 0)) AS DECIMAL(12, 2)) AS s FROM chapters WHERE chapter_id IS NOT NULL AND fiction_id IS NOT NULL AND book IS NOT NULL GROUP BY chapter_id)) GROUP BY ALL""")
def chapter_marks(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.windows import offsets

    c = table(spark, d, "chapters").dropna(subset=["chapter_id", "fiction_id", "book"]).groupBy("chapter_id").agg(F.first("fiction_id").alias("fiction_id"), F.first("book").alias("book"), F.max(F.coalesce("audio_duration_seconds", F.lit(0.0))).cast("decimal(12,2)").alias("s"))
    start, end = offsets("s", ["fiction_id", "book"], ["chapter_id"])
    return R.chapter_marks(c.withColumns({"a": start, "b": end}), ["fiction_id", "book"], "chapter_id", F.col("chapter_id").cast("string"), "a", "b")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN (SELECT l_orderkey AS k, avg(l_discount) AS was, max(l_quantity) > 40 AS bad FROM lineitem GROUP BY 1) ON k = l_orderkey WHERE l_tax > 0.02 AND (NOT bad OR l_tax > was + 0.06)""")
def take_regressions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    shipped = li.groupBy("l_orderkey").agg(F.avg("l_discount").alias("distance"), (F.max("l_quantity") > 40).alias("faulty")).withColumn("word", F.lit("w"))
    takes = li.select("l_orderkey", "l_linenumber", F.lit("w").alias("word"), F.col("l_tax").alias("distance"), (F.col("l_tax") > 0.02).alias("faulty"))
    return K.regressions(shipped, takes, ["l_orderkey"]).select("l_orderkey", "l_linenumber")


@query("""SELECT seq, CASE WHEN r IS NOT NULL AND seq % 4 >= 3 THEN 'fallback' ELSE r END AS reason, 999 + chunk + (seq % 4) * 100003 AS seed FROM (SELECT *, CASE WHEN lower(status) = 'failed' THEN 'failed' WHEN priority > 5 THEN 'early_stop' WHEN length(text) > 200 THEN 'hallucination' END AS r FROM jobs)""")
def retake_reasons(spark: SparkSession, d: str) -> DataFrame:
    round_ = F.col("seq") % 4
    reason = K.retake_reason(F.lower("status") == "failed", F.col("priority") > 5, F.char_length("text") > 200, round_, 3)
    return table(spark, d, "jobs").select("seq", reason.alias("reason"), K.seed(F.col("chunk"), round_).alias("seed"))


@query("""SELECT l_orderkey, shipped, best, cost, best < shipped AS improved, shipped >= 0.05 AND best < 0.05 AS rescued FROM (SELECT l_orderkey, max(l_discount) AS shipped, min(l_tax) AS best, CAST(sum(l_quantity) AS DOUBLE) AS cost FROM lineitem GROUP BY 1)""")
def best_of_takes(spark: SparkSession, d: str) -> DataFrame:
    return K.best_of(table(spark, d, "lineitem"), ["l_orderkey"], "l_discount", "l_tax", "l_quantity", 0.05)


@query("""SELECT l_linenumber, count(*) FILTER (c < 0) AS better, count(*) FILTER (c > 0) AS worse, count(*) FILTER (c = 0) AS same, round(avg(c), 6) AS mean_change FROM (SELECT l_linenumber, l_tax - l_discount AS c FROM lineitem) GROUP BY 1""")
def parameter_sweep(spark: SparkSession, d: str) -> DataFrame:
    return K.sweep(table(spark, d, "lineitem"), ["l_linenumber"], "l_discount", "l_tax")


@query("""SELECT l_shipmode, count(*) AS repeats, count(*) FILTER (a) AS any_hits, count(*) FILTER (e) AS end_hits, max(w) AS worst FROM (SELECT l_returnflag AS l_shipmode, l_orderkey, count(p) > 0 AS a, coalesce(bool_or(p > 0.7), false) AS e, max(l_tax) AS w FROM (SELECT *, CASE WHEN l_quantity > 20 THEN l_quantity / 50.0 END AS p FROM lineitem) GROUP BY 1, 2) GROUP BY 1""".replace("l_shipmode", "flag"))
def trigger_rate(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_orderkey", F.when(F.col("l_quantity") > 20, F.col("l_quantity") / 50.0).alias("p"), "l_tax")
    return K.trigger_rates(li, ["flag"], "l_orderkey", "p", "l_tax")


@query("""SELECT l_orderkey, CAST(coalesce(c, m.l_linenumber) AS INTEGER) AS attempt, c IS NOT NULL AS cleaned FROM (SELECT l_orderkey, min(CASE WHEN l_tax = 0 THEN l_linenumber END) AS c, min(CASE WHEN l_tax < l_discount THEN {'l_tax': l_tax, 'l_linenumber': l_linenumber} END) AS m FROM lineitem GROUP BY 1)""")
def clean_pass(spark: SparkSession, d: str) -> DataFrame:
    return K.clean_pass(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_tax", "l_discount")


@query("""SELECT fiction_id, word, min_by(finding_id, (-coalesce(severity, 0), finding_id)) AS finding_id FROM (SELECT fiction_id, finding_id, severity, unnest(list_distinct(regexp_extract_all(lower(expected), '[a-z0-9]+(?:''[a-z]+)?'))) AS word FROM findings WHERE finding_id IS NOT NULL) GROUP BY ALL""")
def word_defect_lookup(spark: SparkSession, d: str) -> DataFrame:
    return R.first_defect_of_word(table(spark, d, "findings").where("finding_id is not null"), ["fiction_id"])


@query(f"""SELECT doc_id, coalesce(list_filter(string_split(regexp_replace(text, '([.!?]){_S}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: contains(lower(s), 'key'))[1], substr(text, 1, 80)) AS sentence FROM documents""")
def sentence_with_word(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", R.sentence_with(F.col("text"), F.lit("Key")).alias("sentence"))


@query("SELECT l_orderkey, l_linenumber, l_tax < l_discount - 0.03 AS improved FROM lineitem")
def clip_improvement(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", K.improved(F.col("l_discount"), F.col("l_tax")).alias("improved"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'known ' || p_size END AS rendering FROM part""")
def pinned_renderings(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_size", T.block_key(F.array("p_name", "p_type", F.col("p_size").cast("string"))).alias("block_key"))
    kept = p.where("p_size > 25").select(F.col("block_key").alias("key"), F.concat(F.lit("known "), "p_size").alias("rendering")).distinct()
    return R.pinned(p, kept).select("p_partkey", "rendering")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '(Interface reference — see the text version.)' ELSE 'The profile lists 2 fields, from Size to ' || p_brand || '.' END AS said FROM part")
def spec_renderings(spark: SparkSession, d: str) -> DataFrame:
    line = F.when(F.col("p_size") % 3 == 0, F.lit("Only words here")).otherwise(F.concat(F.lit("Size xx "), "p_brand", F.lit(" xx.x Trailing")))
    return table(spark, d, "part").select("p_partkey", R.rendered_fields(B.spec_fields(line)).alias("said"))


@query("""SELECT finding_id FROM (SELECT DISTINCT finding_id, fiction_id, book, chapter, chunk, lower(expected) AS w, phoneme_source, severity FROM findings WHERE expected IS NOT NULL) f WHERE phoneme_source = 'xtts' AND severity >= 0.3 AND NOT EXISTS (SELECT 1 FROM findings g WHERE g.phoneme_source IS NULL AND g.fiction_id = f.fiction_id AND g.book = f.book AND g.chapter = f.chapter AND g.chunk = f.chunk AND lower(g.expected) = f.w)""")
def undescribed_faults(spark: SparkSession, d: str) -> DataFrame:
    keys = ["fiction_id", "book", "chapter", "chunk", "w"]
    f = table(spark, d, "findings").where("expected is not null").select("finding_id", *keys[:4], F.lower("expected").alias("w"), "phoneme_source", "severity").distinct()
    return R.not_yet(f.where("phoneme_source = 'xtts' and severity >= 0.3"), f.where("phoneme_source is null"), keys).select("finding_id")


@query()
def word_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the findings' words, whose letters stand for phones as the tables hold none."""
    f = table(spark, d, "findings").where("finding_id is not null").select("finding_id", "expected", "heard", "context").distinct()
    words = F.split(F.trim("expected"), r"\s+")
    phones = lambda c: P.clean_phones(F.lower(c))
    v = f.select("finding_id", F.explode(V.verdicts(words, F.transform(words, phones), phones(F.col("context")), phones(F.col("heard")))).alias("v"))
    return v.select("finding_id", "v.*")


@query()
def respell_candidates(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "findings").select(F.explode(F.split("expected", " ")).alias("word")).where("word <> ''").distinct()
    return w.select("word", F.array_join(V.respelling_candidates("word"), " ").alias("spellings"))
