"""Operators over DataFrames: filters, guards, joins, rollups, metrics, page units, run logs."""
