"""strandline.sources."""
