"""Training-data operators: one module per operator, one query per operator in ``queries``."""
