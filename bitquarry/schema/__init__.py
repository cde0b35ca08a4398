"""Message schemas: codec nodes and the YAML compiler that makes them."""
