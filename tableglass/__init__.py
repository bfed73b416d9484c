"""Getting to know, checking, cleaning and charting tables of any size with Spark."""
