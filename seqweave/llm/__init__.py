"""Training-data operators: cleaning, mixing, formatting and output of document collections."""
