"""Document intelligence as batch DataFrame operations."""
