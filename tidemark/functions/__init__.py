"""Column expressions and the scalable ordering primitives built on them."""
