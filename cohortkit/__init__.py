"""cohortkit: cohort building, leak-free splits and model evaluation on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or ``Column ->
Column``) built from Spark SQL expressions, so Catalyst sees one lazy plan.
"""

__version__ = "0.1.0"
