"""Spark jobs that monitor and search bibliographic records.

Every job takes DataFrames and returns DataFrames.  Instants are
``TIMESTAMP_NTZ`` columns holding UTC wall time, so results do not depend on
the session time zone.
"""
