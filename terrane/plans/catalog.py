"""All queries over the driver tables."""

from __future__ import annotations

from terrane.plans import files, folds, inventory, judging, merges, reviews, semantic, sightings, spatial
from terrane.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "files", "folds", "inventory", "judging", "merges", "reviews", "semantic", "sightings", "spatial"]
