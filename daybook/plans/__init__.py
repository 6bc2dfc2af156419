"""Wiring: layer build, pipeline run, registered queries and their SQL."""
