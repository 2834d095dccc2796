"""Where rows come from and go to: repository files, git history, TOML entries, versioned tables."""
