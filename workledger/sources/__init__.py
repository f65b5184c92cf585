"""Ingest jobs: source records to events, identity links and relations."""
