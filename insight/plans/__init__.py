"""Query catalogue over the driver tables and the matching oracle SQL."""
