"""Conditional paths over heterogeneous graphs kept as tables, as Spark jobs."""
