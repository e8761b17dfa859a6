"""plans of weftwork."""
