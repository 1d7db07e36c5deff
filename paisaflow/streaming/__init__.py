"""Daily totals kept up to date over a stream of transactions."""
