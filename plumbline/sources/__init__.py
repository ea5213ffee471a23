"""Sources of the toolkit."""
