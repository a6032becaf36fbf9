"""Reports over run logs, endpoints, costs and experiments."""
