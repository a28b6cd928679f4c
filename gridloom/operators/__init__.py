"""Operators on asset tables: topology, connectivity, mapping, validation, objects, ranking."""
