"""Tables that keep arriving. Reading one needs nothing of the others, so a stream takes the same column functions, without state."""
