"""Time stepping and in-situ pipelines."""
