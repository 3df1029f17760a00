"""Plans: operators put together into whole runs."""
