"""Sources, sinks and their registries."""
