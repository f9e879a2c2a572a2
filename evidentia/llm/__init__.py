"""Training-data operators: each is a DataFrame-to-DataFrame function; nothing outside this package imports it."""
