"""De-identification of document corpora as Spark jobs."""
