"""operators of quantloom."""
