"""Functions of the toolkit."""
