"""DataFrame -> DataFrame operators over the long token table (score_id, pos, token)."""
