"""op8: neighbours among `embeddings`."""

from pyspark.sql import functions as F

from strandline.llm.ann import search
from strandline.llm.registry import register
from strandline.session import table

EVERY, NEAREST = 50, 5


@register("op8_inverted_multi_index")
def op8(spark, sf_dir):
    """No SQL: the last digits of a double sum depend on its order. The tests hold it against a brute-force version."""
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0, NEAREST)
