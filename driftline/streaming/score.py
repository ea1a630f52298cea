"""Row rules on a stream: verdict rows are scored as they arrive, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import AFFIRMATIVE, cue, jaccard, tokens


def score_stream(rows: DataFrame, threshold: float = 0.10) -> DataFrame:
    """rows (batch or stream) with question, paraphrase and row_count, and the verdict that the validator's rules give."""
    near = jaccard(tokens(F.col("paraphrase")), tokens(F.col("question")))
    empty = cue(F.col("question"), AFFIRMATIVE) & (F.col("row_count") == 0)
    verdict = F.when(F.col("row_count").isNull(), "execution_error").when(near < threshold, "silent_failure").when(empty, "silent_failure").otherwise("valid")
    return rows.withColumn("similarity", near).withColumn("verdict", verdict)
