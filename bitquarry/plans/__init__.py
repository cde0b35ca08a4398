"""Query plans over the codec layer."""
