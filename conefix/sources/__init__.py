"""sources of the program-fact engine."""
