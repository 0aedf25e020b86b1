"""Documents and files made from a model."""
