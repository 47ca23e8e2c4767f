"""functions of the program-fact engine."""
