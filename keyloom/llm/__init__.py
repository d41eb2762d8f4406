"""Training-data operators: thirteen corpus jobs that share nothing with the rest of the library."""
