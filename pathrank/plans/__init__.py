"""Path specifications: what a query asks for, without data."""
