"""Scalar codecs: bit strings, packed floats, five-bit text, checked arithmetic."""
