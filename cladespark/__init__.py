"""Clade typing of pathogen samples as Spark DataFrame jobs."""
