"""Per-pixel operators on streams; stateless ones are the batch operators themselves."""
