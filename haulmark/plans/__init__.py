"""Query registry, SQL oracles and the batch run."""
