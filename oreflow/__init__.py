"""Artefact analytics on Spark."""
