"""Incremental runs over vintages; the engine is batch only, so there is no long-running query here."""
