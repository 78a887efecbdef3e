"""Views over the driver's tables and the registered queries with their SQL."""
