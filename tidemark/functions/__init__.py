"""Column builders: casts, text and array clean-up, money, dates, hashes, rule predicates."""
