"""cohort_risk: student-risk analytics on Spark.

Pure DataFrame-in / DataFrame-out building blocks (``functions``,
``operators``, ``sources``, ``streaming``) and the named queries built from
them (``plans``). See README.md.
"""

__version__ = "0.1.0"
