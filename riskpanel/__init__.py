"""Area-panel risk indicators on Spark: clean, label, score and report weekly area panels."""
