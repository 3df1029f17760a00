"""Registered queries: the operators' rules on the driver's tables, in which a row stands in for a page or box."""
