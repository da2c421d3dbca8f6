"""Cohort audits and selective-reliability measurement as Spark DataFrame functions."""
