"""Inputs and outputs: listings, probe payloads, provider catalogs, caches, reports, config."""
