"""tablelens.sources."""
