"""SQL mode and the catalogue of registered queries."""
