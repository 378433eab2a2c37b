"""portflow: traffic-record analytics as Spark DataFrame jobs.

A traffic record is one dated observation of trips between an origin and a
destination port on a route, with two measured volumes (passengers and
vehicles). The package turns raw records into clean, deduplicated, keyed
tables, rolls them up by day/week/month/year, runs declared data-quality
checks and answers analytical questions on top.
"""

__all__ = ["session"]
