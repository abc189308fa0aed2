"""Where rows come from and go to: the log, the derived store, followed files."""
