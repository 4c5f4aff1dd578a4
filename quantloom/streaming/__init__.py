"""streaming of quantloom."""
