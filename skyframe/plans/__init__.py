"""Named catalogs and the table roles."""
