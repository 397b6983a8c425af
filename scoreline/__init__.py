"""Head-to-head event analytics as functions from DataFrame to DataFrame."""
