"""Whole queries and jobs: the engine, the maintenance plan, the catalogue."""
