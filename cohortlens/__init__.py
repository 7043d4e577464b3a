"""cohortlens: cohort statistics and risk modelling as Spark DataFrame jobs."""

__version__ = "0.1.0"
