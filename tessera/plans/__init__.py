"""Plans: the star-schema load, the reports and the registered query catalogue."""
