"""Tables and their maintenance."""
