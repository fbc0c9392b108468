"""The kernel language and its compiler to DataFrame plans."""
