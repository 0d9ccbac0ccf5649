"""Column expressions: slots, error kinds, formats, and the binary codecs."""
