"""The registered queries with their reference SQL."""
