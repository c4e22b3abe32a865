"""Column functions with the engine's null discipline."""
