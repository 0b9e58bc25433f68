"""tablelens.operators."""
