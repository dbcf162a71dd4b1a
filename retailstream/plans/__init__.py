"""Reports: pure functions from tables to result frames."""
