"""Adapters from the driver's tables to the model-data shapes, and the registered query catalog."""
