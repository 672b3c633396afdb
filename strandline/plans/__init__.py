"""The projection of relational tables onto graph tables, and the queries over it."""
