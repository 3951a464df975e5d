"""Tables and their stand-in columns."""
