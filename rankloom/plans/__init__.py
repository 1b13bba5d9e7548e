"""Query plans registered with the driver, and their SQL twins."""
