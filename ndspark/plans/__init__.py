"""Planning: how filters, alignment and layout become DataFrame operations."""
