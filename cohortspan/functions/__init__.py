"""Column expressions: bands, flags and distribution tails."""
