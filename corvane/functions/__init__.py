"""Column functions over text, paths and progress."""
