"""Run tables, layouts and declarative flows."""
