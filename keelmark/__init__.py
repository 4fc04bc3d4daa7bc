"""Incident-risk scoring and war-risk premium pricing on Spark DataFrames."""
