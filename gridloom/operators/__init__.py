"""Operators over grids: access, boundaries, reductions, scatters, scans, sorting, linear algebra."""
