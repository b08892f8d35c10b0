"""Sheets to documents: one sheet is laid out by plain functions, and files and sheets are spread over tasks."""
