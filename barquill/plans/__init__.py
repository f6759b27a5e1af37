"""Queries over the driver's tables. Importing a module registers its queries."""
