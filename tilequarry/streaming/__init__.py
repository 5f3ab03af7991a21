"""Images that keep arriving."""
