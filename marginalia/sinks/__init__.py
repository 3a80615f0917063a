"""Writing results once: new, identical or refused."""
