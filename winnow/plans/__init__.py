"""Report tables, derived views and the registered queries."""
