"""Named queries built from the operators, each with its SQL equivalent."""
