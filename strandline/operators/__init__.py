"""strandline.operators."""
