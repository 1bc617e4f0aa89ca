"""Training-data operators: each module holds one, ``queries`` applies them to the test tables."""
