"""tablelens.streaming."""
