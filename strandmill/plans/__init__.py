"""Query plans over the driver tables: adapters, pipelines and the query catalog."""
