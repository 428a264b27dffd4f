"""Sources: file trees, embedding providers, strict JSON."""
