"""Column functions: tile ids, projections, proportions, geometry text and array payloads."""
