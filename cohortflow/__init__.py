"""Cohort building, feature engineering, modelling and bias audit on Spark."""

from cohortflow.session import get_spark, shared_dir

__all__ = ["get_spark", "shared_dir"]
