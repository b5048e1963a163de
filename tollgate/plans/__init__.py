"""Composed plans: the audit, the driver-data views and the query catalog."""
