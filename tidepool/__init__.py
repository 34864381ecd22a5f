"""Analyses of physiological series and survey data, as Spark jobs."""
