"""Column expressions: text cleaning, term dictionaries, reply parsing, search predicates."""
