"""Model inference behind a boundary that tests and models share."""
