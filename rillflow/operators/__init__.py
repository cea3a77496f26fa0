"""Filters, maps, joins, aggregates and exchanges as functions over DataFrames."""
