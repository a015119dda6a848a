"""Queries assembled from the operators: KPIs, answers, findings."""
