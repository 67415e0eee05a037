"""Spark jobs for document intake, matching, scoring and hiring analytics.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is collected on the driver except bounded summaries.
"""
