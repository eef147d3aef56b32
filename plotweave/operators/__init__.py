"""DataFrame-to-DataFrame operators: graphs, positions, catalog, ingest, state, corpus."""
