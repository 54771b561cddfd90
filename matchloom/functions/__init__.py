"""Column expressions. Everything here is in-row: no function in this package shuffles."""
