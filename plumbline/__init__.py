"""plumbline: Spark jobs that audit volumetric training data and text corpora."""
