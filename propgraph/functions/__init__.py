"""Column functions: value readers and value type detection."""
