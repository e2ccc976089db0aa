"""Registered checks: each inventory job run on the driver tables, beside its SQL twin."""
