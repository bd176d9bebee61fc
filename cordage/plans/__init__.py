"""Whole jobs put together from the operators, and the queries of the driver contract."""
