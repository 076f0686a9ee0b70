"""Relational operators on point, voxel, patch, edge, observation, target and object tables."""
