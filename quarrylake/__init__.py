"""quarrylake: project-memory, code-graph and training-data operators on Spark."""
