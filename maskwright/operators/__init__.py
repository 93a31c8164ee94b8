"""DataFrame operators; every table is keyed by ``doc_id``."""
