"""sources of weftwork."""
