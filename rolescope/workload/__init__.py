"""The registered queries and their oracle SQL over the given test tables."""
