"""tablelens.plans."""
