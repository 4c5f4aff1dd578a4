"""sources of quantloom."""
