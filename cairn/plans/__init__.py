"""How lines become sections."""
