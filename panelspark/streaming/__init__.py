"""No streaming operators: every run rebuilds its tables and late data is handled by release diffs."""
