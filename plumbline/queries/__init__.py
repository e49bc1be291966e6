"""Registered queries by pipeline; each module has QUERIES and ORACLES."""
