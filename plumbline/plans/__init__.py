"""Plans of the toolkit."""
