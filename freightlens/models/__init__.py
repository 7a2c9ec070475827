"""Models on Spark ML: preprocessing, components, trees, validation, artifacts."""
