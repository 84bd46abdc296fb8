"""Named reports composed of the operators."""
