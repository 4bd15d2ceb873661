"""Demand-driven planning: boxes, intervals and the functions compiled over them."""
