"""Report, trend, catalog, registry, validation, job and policy operators."""
