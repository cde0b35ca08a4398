"""Encode, decode, validate and measure packed columns."""
