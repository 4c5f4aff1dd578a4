"""functions of quantloom."""
