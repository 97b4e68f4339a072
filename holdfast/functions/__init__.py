"""Column expressions: time arithmetic, number formatting, policy rules, driver texts."""
