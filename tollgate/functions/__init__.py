"""Column expressions: normalisation, fingerprints, tokens, PII matchers."""
