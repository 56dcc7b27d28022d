"""Native Column expressions: vocabulary, tokens, pitches."""
