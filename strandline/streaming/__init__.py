"""strandline.streaming."""
