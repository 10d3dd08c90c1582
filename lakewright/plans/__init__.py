"""Query registry and the SQL compiler."""
