"""Training-data operators: one module per operator, plus the thin queries in ``queries``."""
