"""tablelens.functions."""
