"""Spreadsheet structure on Spark: cells as relations, segments, headers, merges and renderings as DataFrame operators."""
