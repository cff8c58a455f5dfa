"""File sources and code extraction."""
