"""Query plans over the star schema and the event table."""
