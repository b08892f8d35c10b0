"""Operators on cells(sheet, r, c, v): segmentation, headers, ordering. All are DataFrame to DataFrame."""
