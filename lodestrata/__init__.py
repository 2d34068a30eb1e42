"""lodestrata: DataFrame-to-DataFrame operators for evidence retrieval and civic triage on Spark."""
