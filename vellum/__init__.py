"""Outline analytics and corpus preparation on Spark."""
