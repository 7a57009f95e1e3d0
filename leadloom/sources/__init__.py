"""Where rows come from: the registry of tables, catalog tables, seed rows."""
