"""Query registry: each query is a function of a session and a table folder."""
