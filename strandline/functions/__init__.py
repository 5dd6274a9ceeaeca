"""strandline.functions."""
