"""Queries of the training-data operators; ``__spark_entry__`` adds them when this subpackage is there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .lookalike import look_alike_classes, pairs_of, with_one_form
from .ngrams import marked, ngram_counts, terms_of, whole_value
from .packing import pack_texts
from .readability import reading_levels
from .repeated_lines import Repeated, repeated_lines, repeated_templates, text_records, without_lines
from .sentences import sentence_model_of, sentence_units
from .splitting import cut_inside_runs, split_oversized
from .tokenizer import encode_corpus


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = None
    for name, row_id in (("documents", "doc_id"), ("chunk_results", "row_id"), ("jobs", "seq")):
        part = table(spark, sf_dir, name).select(F.lit(name).alias("place"), F.col(row_id).alias("row_id"), "text")
        texts = part if texts is None else texts.unionByName(part)
    return sentence_units(texts, sentence_model_of(table(spark, sf_dir, "documents")))


def _site_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = text_records(table(spark, sf_dir, "documents"), "documents", "doc_id", "source", "text")
    jobs = text_records(table(spark, sf_dir, "jobs"), "jobs", "seq", "source", "text", ["fiction_id", "book", "chapter"])
    chapters = text_records(table(spark, sf_dir, "chapters"), "chapters", "chapter_id", "source", "title")
    return documents.unionByName(jobs).unionByName(chapters)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines(_site_texts(spark, sf_dir))


def p2_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_templates(_site_texts(spark, sf_dir))


def _without_site_lines(records: DataFrame) -> DataFrame:
    """Texts without the site lines of their source; those without source lose the site lines of any."""
    repeated = Repeated(records)
    found = repeated.found().unionByName(repeated.found_without_source())
    return without_lines(records.select("place", "row_id", "text"), ["place", "row_id"], "text", found)


def p2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _without_site_lines(_site_texts(spark, sf_dir))


def _look_alikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return look_alike_classes(table(spark, sf_dir, "normalize_cases"), "case_id", ["input", "expected"])


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _look_alikes(spark, sf_dir).select("field_name", F.col("key").alias("case_id"), "class_id", "links")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs_of(_look_alikes(spark, sf_dir))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "normalize_cases").select("case_id", "input", "expected")
    return with_one_form(cases, ["input", "expected"]).drop("input", "expected").distinct()


def _finding_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = table(spark, sf_dir, "findings").select("finding_id", "kind", "expected")
    one = findings.select(F.lit("expected").alias("field_name"), "finding_id", terms_of(F.col("expected")).alias("terms"))
    return one.unionByName(findings.select(F.lit("kind").alias("field_name"), "finding_id", whole_value(F.col("kind")).alias("terms")))


def p4_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ngram_counts(_finding_terms(spark, sf_dir), "field_name", "finding_id", "terms")
    return marked(counts, table(spark, sf_dir, "findings"), "finding_id")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = p4_ngrams(spark, sf_dir).where("n_terms = 1 and verdict is not null")
    return terms.select("field_name", F.col("ngram").alias("term"), "verdict")


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(table(spark, sf_dir, "chunk_results"), table(spark, sf_dir, "chunk_profiles"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_inside_runs(_pieces(spark, sf_dir))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pieces(spark, sf_dir)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = text_records(table(spark, sf_dir, "documents"), "documents", "doc_id", "source", "text")
    texts = _without_site_lines(records).select(F.col("row_id").alias("doc_id"), "text")
    return reading_levels(texts, table(spark, sf_dir, "level_labels"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_levels(spark, sf_dir).where("demanding and lang in ('en', 'de', 'fr', 'es')").select("doc_id").distinct()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p2_documents": p2_documents,
        "p2_templates": p2_templates,
        "p3_found": p3_found,
        "p3_classes": p3_classes,
        "p3_forms": p3_forms,
        "p4_found": p4_found,
        "p4_ngrams": p4_ngrams,
        "p5_found": p5_found,
        "p5_pieces": p5_pieces,
        "p6_ids": p6_ids,
        "p7_containers": p7_containers,
        "p8_found": p8_found,
        "p8_levels": p8_levels,
    }


#: White space as a class for DuckDB's regular expressions.
_S = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

_P2 = f"""WITH t AS (SELECT 'documents' AS place, source, doc_id AS row_id, CAST(doc_id AS VARCHAR) AS record, text FROM documents UNION ALL
SELECT 'jobs', source, seq, concat_ws('|', coalesce(fiction_id, '-'), coalesce(CAST(book AS VARCHAR), '-'), coalesce(CAST(chapter AS VARCHAR), '-')), text FROM jobs UNION ALL SELECT 'chapters', source, chapter_id, CAST(chapter_id AS VARCHAR), title FROM chapters),
l AS (SELECT place, source, row_id, record, line_no, regexp_replace(regexp_replace(regexp_replace(lower(line), '^{_S}+|{_S}+$', '', 'g'), '{_S}+', ' ', 'g'), '\\p{{Nd}}+', '0', 'g') AS k
FROM (SELECT place, source, row_id, record, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS INTEGER) AS line_no FROM (SELECT *, string_split(text, chr(10)) AS ls FROM t WHERE source IS NOT NULL)) WHERE length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) >= 3),
c AS (SELECT place, source, k, count(DISTINCT record) AS n FROM l GROUP BY ALL), a AS (SELECT place, source, count(DISTINCT record) AS n FROM t WHERE source IS NOT NULL GROUP BY ALL)
SELECT DISTINCT place, row_id, line_no FROM l JOIN c USING (place, source, k) JOIN a USING (place, source) WHERE c.n >= 4 AND c.n >= 0.02 * a.n"""

_P4 = f"""WITH r AS (SELECT DISTINCT finding_id, kind, expected FROM findings WHERE finding_id IS NOT NULL), t AS (SELECT 'expected' AS field_name, finding_id, unnest(regexp_extract_all(lower(expected), '[\\p{{L}}\\p{{M}}\\p{{N}}]+')) AS term FROM r
UNION ALL SELECT 'kind', finding_id, lower(regexp_replace(kind, '^{_S}+|{_S}+$', '', 'g')) FROM r WHERE kind IS NOT NULL)
SELECT field_name, term, CASE WHEN n < 3 THEN 'rare' ELSE 'common' END AS verdict FROM (SELECT field_name, term, count(DISTINCT finding_id) AS n FROM t WHERE term <> '' GROUP BY ALL) WHERE n < 3 OR n > 0.05 * (SELECT count(DISTINCT finding_id) FROM findings)"""

_P5 = r"""SELECT DISTINCT row_id FROM chunk_results JOIN chunk_profiles USING (profile) WHERE length(text) > max_chars
AND list_max(list_transform(string_split_regex(text, '[\t-\r \x{85}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}。！？、，；：…]'), lambda x: length(x))) > max_chars"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p4_found": _P4, "p5_found": _P5}
