"""adlens — advertising-performance analytics as Spark DataFrame plans.

Every public function takes DataFrames (plus plain parameters) and returns a
DataFrame.  Nothing is collected to the driver except schema-only decisions
(header detection) and a handful of bounded result tables (at most a few
rows per cluster label) that are documented where they happen.
"""

__version__ = "0.1.0"
