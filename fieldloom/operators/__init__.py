"""Operators on fields, meshes, volumes and images."""
