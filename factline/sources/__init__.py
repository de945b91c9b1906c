"""Sources: files, git, JSON and markdown."""
