"""Operators for preparing training text: filters, fingerprints, encoders, shards and sequences."""
