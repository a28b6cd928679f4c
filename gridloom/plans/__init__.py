"""The registered queries, each with its SQL twin."""
