"""Reading and writing datasets, lookup tables and fitted models."""
