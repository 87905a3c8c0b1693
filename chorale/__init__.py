"""Forum-comment corpora on Spark: collect, clean, sample, score, validate, assemble."""
