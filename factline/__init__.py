"""factline: a Spark-first engine for line-anchored facts.

Facts live in DataFrames; every operator takes DataFrames and returns a
DataFrame, so Catalyst sees one declarative plan from scan to report.
"""
