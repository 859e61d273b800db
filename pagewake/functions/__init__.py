"""Column functions: URLs, text and identity keys."""
