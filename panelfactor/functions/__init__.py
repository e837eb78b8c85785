"""Column functions and statistical tests."""
