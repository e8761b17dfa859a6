"""functions of weftwork."""
