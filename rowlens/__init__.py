"""Automatic analysis of tables on Spark.

The public entry points are :func:`rowlens.plans.analyze.analyze` for a whole run
and the functions in ``rowlens.operators`` for single steps.
"""

__version__ = "0.1.0"
