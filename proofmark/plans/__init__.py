"""The label surface over the supplied tables, and the registered queries."""
