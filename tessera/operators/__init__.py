"""Scans, joins, aggregates, versions and logs as DataFrame operators."""
