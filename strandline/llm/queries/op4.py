"""op4: quality of `documents`."""

from strandline.llm.quality import fitted, scored
from strandline.llm.registry import register
from strandline.session import table


@register("op4_boosted_quality")
def op4(spark, sf_dir):
    """No SQL: a trained model. The tests measure its held-out accuracy."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, fitted(docs, table(spark, sf_dir, "labels")))
