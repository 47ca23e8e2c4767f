"""streaming of the program-fact engine."""
