"""Column functions and reusable numeric building blocks."""
