"""Queries as text or JSON, and graph views over other tables."""
