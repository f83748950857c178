"""Functions registered so that plain SQL can call them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.words import in_words
from .operators.alignment import seq_ratio
from .operators.chunking import LONG, SHORT, chunks_of
from .operators.normalize import spoken


def register(spark: SparkSession) -> None:
    """seq_ratio(a, b), speak(t) — abbreviations, initialisms and figures in words — and number_to_words(n); and the table function chunk_text(t, profile)."""
    spark.udf.register("seq_ratio", seq_ratio)
    spark.udf.register("speak", F.pandas_udf(lambda s: s.map(spoken, na_action="ignore"), "string"))
    spark.udf.register("number_to_words", F.pandas_udf(lambda s: s.map(lambda n: in_words(int(n)), na_action="ignore"), "string"))

    @F.udtf(returnType="chunk: int, text: string")
    class ChunkText:
        def eval(self, text: str, profile: str):  # noqa: ANN201
            yield from enumerate(chunks_of(text or "", LONG if profile == "long" else SHORT), 1)

    spark.udtf.register("chunk_text", ChunkText)
