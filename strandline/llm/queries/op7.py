"""op7: `documents` packed into sequences."""

from pyspark.sql import functions as F

from strandline.llm.packing import packed, pieces, tokenizer_path
from strandline.llm.registry import register
from strandline.session import table


@register("op7_best_fit_packing")
def op7(spark, sf_dir):
    """No SQL: DuckDB has no tokenizer. The tests hold it against a brute-force version."""
    rows = packed(pieces(table(spark, sf_dir, "documents"), tokenizer_path()))
    return rows.withColumn("length", F.col("length").cast("long"))
