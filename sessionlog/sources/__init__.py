"""Where entries and blocks come from, and where results go."""
