"""Pipelines, reports and the catalogue of named queries."""
