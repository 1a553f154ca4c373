"""Pipelines, providers, reports and the command line."""
