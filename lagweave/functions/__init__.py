"""Column builders: cleaning, calendar, scaling and metric expressions."""
